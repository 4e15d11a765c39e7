"""Best-fit packing of tokenized documents by exact-complement hashing.

Only the histogram of piece lengths decides how sequences are built (one count per length, so at most ``size`` numbers).
The longest remaining length is matched with a single length, a pair or a triple that fills its gap exactly, as often
as the counts allow; what cannot be filled exactly is packed best fit. The plan says how many sequences have which
lengths; the pieces themselves are numbered within their length and look up their place in it.

Scale: tokenizing writes, with every piece, its number among equal lengths in its own task; counts by task and length
are summed over tasks, so numbering needs no sort and no window over a popular length. Only the plan (bounded by
``size``) is sent to the tasks.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lobspark.llm.common import chunks
from lobspark.llm.words import ragged, split_at_space
from lobspark.session import materialize

#: Bytes of text handled at once (a worker peaks at 0.35 GB with 1 MB, at 0.6 GB with 4 MB), and distinct words whose ids a task remembers.
TEXT_AT_ONCE, REMEMBERED = 1_000_000, 500_000


class WordIds:
    """Ids of white-space separated words by one tokenizer; words met before are looked up by their 64-bit hash.

    The tokenizer's own rules never join text across white space, so a text's ids are its words' ids. A word of plain
    letters with commas or full stops after it goes straight to the merge model; every other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.low = {c: level.pre_tokenize_str(c)[0][0] for c in letters}
        self.low |= {c.upper(): self.low[c] for c in letters if len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c}
        self.table = str.maketrans(self.low)
        self.plain = set(self.low)
        self.tails: dict[str, list[int]] = {"": []}
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def slow(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, words: list[str]) -> list[list[int]]:
        out: list = []
        hard: list[int] = []
        for w in words:
            core = w.rstrip(".,")
            if core and self.plain.issuperset(core):
                ids = [t.id for t in self.model.tokenize(core.translate(self.table))]
                tail = w[len(core) :]
                if tail:
                    if tail not in self.tails:
                        self.tails[tail] = self.slow([tail])[0]
                    ids += self.tails[tail]
                out.append(ids)
            else:
                hard.append(len(out))
                out.append(w)
        for i, ids in zip(hard, self.slow([out[i] for i in hard])):
            out[i] = ids
        return out

    def look_up(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and each text's bounds in them."""
        w = split_at_space(texts)
        if len(self.known) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.known, w.hashes)
        new = np.ones(len(w.hashes), dtype=bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != w.hashes[inside]
        if new.any():
            s, e = w.distinct()
            raw = w.buffer.tobytes()
            fresh = self.encode([raw[i:j].decode() for i, j in zip(s[new].tolist(), e[new].tolist())])
            size = np.fromiter(map(len, fresh), dtype=np.int64, count=len(fresh))
            base = len(self.ids)
            self.ids = np.concatenate([self.ids, np.array([i for x in fresh for i in x], dtype=np.uint32)])
            known = np.concatenate([self.known, w.hashes[new]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.at = np.concatenate([self.at, base + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            at = np.searchsorted(self.known, w.hashes)
        at = at[w.which]
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[ragged(self.at[at], size)], ends[w.bounds]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(path: str | None, name: str, size: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path or vocabulary(name))
        part = TaskContext.get().partitionId()
        numbered = np.zeros(size + 1, dtype=np.int64)
        for b in batches:
            for i, j in chunks([(n or 0) + 1 for n in pc.binary_length(b["text"]).to_pylist()], TEXT_AT_ONCE):
                flat, bounds = ids_of.look_up([t or b"" for t in b["text"].slice(i, j - i).to_pylist()])
                doc, piece, length, nth, crc, kept = [], [], [], [], [], []
                for d in range(j - i):
                    ids = np.append(flat[bounds[d] : bounds[d + 1]], np.uint32(0)).astype("<u4").tobytes()
                    for k in range(0, len(ids), 4 * size):
                        part_ids = ids[k : k + 4 * size]
                        n = len(part_ids) // 4
                        doc.append(i + d)
                        piece.append(k // (4 * size))
                        length.append(n)
                        nth.append(numbered[n])
                        numbered[n] += 1
                        crc.append(zlib.crc32(part_ids))
                        if keep_ids:
                            kept.append(np.frombuffer(part_ids, dtype="<u4").astype(np.int32))
                cols = [b["row"].take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(doc), pa.int32()), pa.array(nth, pa.int64())]
                names = ["row", "piece", "length", "ids_crc32", "part", "nth"]
                if keep_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """How many sequences to build of which lengths, from the number of pieces of each length."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        values, times = np.unique(lengths, return_counts=True)
        n = int((left[values] // times).min())
        left[values] -= n * times
        out.append((lengths, n))

    def filled(gap: int, first: int) -> tuple[int, ...] | None:
        """Lengths in stock that sum to the gap exactly: one, two or three of them, the larger the better."""
        left[first] -= 1
        try:
            if left[gap] > 0:
                return (gap,)
            here = np.flatnonzero(left[: gap + 1] > 0)
            for a in here[::-1]:
                if 2 * a < gap:
                    break
                if left[gap - a] > (a == gap - a):
                    return (int(a), int(gap - a))
            for a in here[::-1]:
                if 3 * a < gap:
                    break
                left[a] -= 1
                rest = gap - a
                b = here[(here <= min(a, rest)) & (2 * here >= rest)][::-1]
                ok = b[(left[b] > 0) & (left[rest - b] > (b == rest - b))]
                left[a] += 1
                if len(ok):
                    return (int(a), int(ok[0]), int(rest - ok[0]))
            return None
        finally:
            left[first] += 1

    take((size,))
    for length in range(size - 1, 0, -1):
        while left[length] > 0 and (more := filled(size - length, length)):
            take((length, *more))
    for length in range(size - 1, 0, -1):
        while left[length] > 0:
            chosen, gap = [length], size - length
            left[length] -= 1
            while gap and len(fits := np.flatnonzero(left[: gap + 1] > 0)):
                chosen.append(int(fits[-1]))
                left[fits[-1]] -= 1
                gap -= int(fits[-1])
            np.add.at(left, chosen, 1)
            take(tuple(chosen))
    return [x for x in out if x[1]]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, by rank among its pieces: rows of (first rank, first sequence, offset)."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            rows.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, size: int = 2048, carry: list[str] | None = None, path: str | None = None, name: str = "word_bpe_49k.json", keep_ids: bool = False) -> DataFrame:
    """Tokenize every text, end it with id 0, cut what is longer than ``size`` and pack all pieces into sequences.

    ``docs`` has ``text``; the columns named by ``carry`` (``doc_id`` if none) come back in ``row``. ``path`` is the tokenizer file (by default
    the public one called ``name``). One row per piece: ``row, piece, start, length, ids_crc32, sequence_id, offset`` and
    ``ids`` if they are to be kept.

    Defined cases: a null or empty text is the one id 0; equal rows are packed each on its own; any order of equal lengths
    is as good as any other, so which of them lands in which sequence may differ between runs; an empty table gives no rows.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in (carry or ["doc_id"])]).alias("row"), F.col("text").cast("binary").alias("text"))
    kind = f"row {d.schema['row'].dataType.simpleString()}, piece int, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * keep_ids
    pieces = materialize(d.mapInArrow(_pieces(path, name, size, keep_ids), kind))
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = _slots(plan(counts, size))
    before = by_task.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(zero_copy_only=False), b["rank"].to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                at, rows = np.flatnonzero(length == n), slots[int(n)]
                slot = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                sequence[at], offset[at] = slot[:, 1] + rank[at] - slot[:, 0], slot[:, 2]
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    last = ["ids"] * keep_ids
    ranked = pieces.join(before, ["part", "length"]).select("row", "piece", (F.col("piece").cast("long") * size).alias("start"), "length", "ids_crc32", *last, (F.col("before") + F.col("nth")).alias("rank"))
    out = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, out)
