"""Substring dedup over word windows by level-wise doubling.

Level one compares windows of about a quarter of the wanted length. Only windows that are repeated there are
extended, to half and then to the whole wanted length; what is not repeated at a level is never looked at again.

Scale: level one need not compare every window. Each wanted window stands for the level-one window in it with the
smallest hash, so equal windows meet under one hash, and consecutive windows with the same smallest hash travel
as one row (about one row for 20 words). A hash seen in one document only ends there. Stretches whose whole
contents are equal are decided by their content hash; only stretches that share a level-one window but differ
elsewhere are expanded, and then only one copy of each content. All grouping is JVM-side with map-side
combination; no group is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import Rolling, keyed, merged, scan_runs, spans_joined
from lobspark.session import materialize


def _symbols(text: bytes) -> np.ndarray:
    """Hashes of a text's words (bytes split at exactly 0x20 and 0x09-0x0D)."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(0)), dtype=np.uint64, count=len(words))


def _level_one(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, th = b["key"].to_numpy(zero_copy_only=False), b["text_hash"].to_numpy(zero_copy_only=False)
            for doc, start, count, least, content, _ in scan_runs([_symbols(t) for t in b["text"].to_pylist()], length, gram):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least.view(np.int64)), pa.array(content.view(np.int64)), pa.array(key[doc]), pa.array(th[doc]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["h", "c", "key", "text_hash", "start", "n"],
                )

    return run


def _extended(length: int, half: int):
    """Windows of whole length in the wanted stretches of a document, by doubling: half, then both halves joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, asks, key, th in zip(b["text"].to_pylist(), b["asks"].to_pylist(), b["key"].to_pylist(), b["text_hash"].to_pylist()):
                sym = _symbols(text)
                a = Rolling(sym, 0x9E6C63D0876A9F4D).windows(half)
                whole = a[: len(a) - length + half] * np.uint64(0x9FB21C651E98DF25) + a[length - half :]
                start = np.array([x["start"] for x in asks])
                n = np.array([x["n"] for x in asks])
                at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([x["h"] for x in asks], n)), pa.array(np.repeat([x["c"] for x in asks], n)), pa.array(whole[at].view(np.int64)), pa.array((at - np.repeat(start, n)).astype(np.int32)), pa.array(np.full(len(at), key, dtype=np.int64))],
                    names=["h", "c", "w", "i", "key"],
                )

    return run


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """``(key, text_hash, start, end)``: word spans covered by windows that also start under a smaller key."""
    gram, half = max(1, -(-length // 4)), -(-length // 2)
    runs = materialize(docs.select("key", "text_hash", "text").mapInArrow(_level_one(length, gram), "h long, c long, key long, text_hash long, start int, n int"))
    level = runs.groupBy("h").agg(F.min("key").alias("k0"), F.max("key").alias("k1"), (F.min("c") != F.max("c")).alias("mixed")).where("k0 < k1").drop("k1")
    hit = materialize(runs.join(level, "h"))
    plain = hit.where("not mixed and key > k0").select("key", "text_hash", "start", (F.col("start") + F.col("n") + length - 1).alias("end"))
    mixed = hit.where("mixed")
    first = mixed.groupBy("h", "c").agg(F.min(F.struct("key", "text_hash", "start", "n")).alias("f"))
    later = mixed.join(first, ["h", "c"]).where(F.col("key") > F.col("f.key")).select("key", "text_hash", "start", (F.col("start") + F.col("n") + length - 1).alias("end"))
    asks = first.select("f.*", "h", "c").groupBy("key", "text_hash").agg(F.collect_list(F.struct("start", "n", "h", "c")).alias("asks"))
    texts = docs.select("key", "text_hash", "text").join(asks, ["key", "text_hash"])
    windows = materialize(texts.mapInArrow(_extended(length, half), "h long, c long, w long, i int, key long"))
    least = windows.groupBy("h", "w").agg(F.min("key").alias("k0"), F.max("key").alias("k1")).where("k0 < k1").drop("k1")
    inside = windows.join(least, ["h", "w"]).where("key > k0").select("h", "c", "i", "key").distinct()
    own = mixed.select("h", "c", "key", "text_hash", "start").join(inside, ["h", "c", "key"]).select("key", "text_hash", (F.col("start") + F.col("i")).alias("start"), (F.col("start") + F.col("i") + length).alias("end"))
    return plain.union(later).union(own)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, sha, kept = [], [], [], []
        for text, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist()):
            words = text.split()
            left, gone = words, 0
            if spans:
                s, e = merged(np.array([x["start"] for x in spans]), np.array([x["end"] for x in spans]))
                left, gone = [], int((e - s).sum())
                for i, j in zip([0, *e.tolist()], [*s.tolist(), len(words)]):
                    left += words[i:j]
            out = b" ".join(left)
            n_words.append(len(words))
            n_removed.append(gone)
            sha.append(hashlib.sha256(out).hexdigest())
            kept.append(out if gone else text)
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_words", "n_removed", "kept_sha256", "kept"])


def substring_dedup(docs: DataFrame, length: int = 50, carry: list[str] | None = None) -> DataFrame:
    """Remove every word covered by a window of ``length`` words that also starts in a document with a smaller id.

    ``docs`` has ``doc_id`` (long) and ``text``; further columns are carried in ``row`` if named. One result row
    per input row: ``row, n_words, n_removed, kept_sha256, kept``. ``kept`` is the untouched text where nothing
    was removed, else the kept words joined by one space; the digest is always that of the joined words.

    Defined cases: a null text has no words; texts shorter than the window lose nothing; a null ``doc_id`` counts
    as smaller than every other; rows with equal ids never remove from each other; an empty table gives no rows.
    """
    d = keyed(docs, carry)
    kind = d.schema["row"].dataType.simpleString()
    full = spans_joined(d, repeated_spans(d, length)).select("row", "text", "spans")
    return full.mapInArrow(_kept, f"row {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
