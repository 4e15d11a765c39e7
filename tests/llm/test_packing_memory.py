"""A packing worker holds little beside its vocabulary, however large a batch of texts it gets."""

import tracemalloc

import pyarrow as pa

from lobspark.llm import packing


def test_a_large_batch_is_tokenized_in_small_memory(monkeypatch):
    class Context:
        get = staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})())

    monkeypatch.setattr(packing, "TaskContext", Context)
    texts = [b" ".join(b"word%d" % (k * (i % 7 + 1) % 400) for k in range(600)) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([*texts[:-1], None], pa.binary())], names=["row", "text"])
    assert batch["text"].nbytes > 7_000_000
    run = packing._pieces(None, "word_bpe_49k.json", 2048, False)
    tracemalloc.start()
    out = pa.Table.from_batches(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert sorted(set(out["row"].to_pylist())) == list(range(2000)) and out["length"].to_pylist()[-1] == 1
