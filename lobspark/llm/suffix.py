"""Suffix-array dedup of byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A task sorts the suffixes of one shard of text, takes the Burrows-Wheeler transform and walks it breadth first:
the interval of a string w is extended backward by every symbol before it, and an interval whose right end has no
common prefix length yet gives it the length of w. Lengths therefore come out in increasing order and the walk stops
at the wanted length: boundaries still open lie between suffixes that share at least that many bytes.

Scale: a shard must hold every place where a string can be repeated. Each window of the wanted length is dealt by
the smallest hash of the short grams in it; consecutive windows with the same smallest hash travel as one stretch.
Hashes seen once in the whole corpus end there, equal stretches become one content with a weight (a hash with a
single repeated content needs no expansion: its interval is that content), and a shard holds
about ``SHARD_BYTES`` of contents. A hash with more distinct contents than a shard may hold is dealt
again, by the hash of each whole window, which no group can make large. Texts are joined by document, never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import keyed, merged, mix, scan_runs, spans_joined
from lobspark.session import materialize

#: Bytes of contents that a shard holds on average, and that one hash may bring into it.
SHARD_BYTES, HOT_BYTES = 1 << 20, 4 << 20
#: Length of the grams whose smallest hash deals out a window.
GRAM = 32
_LIFT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _stretches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, th = b["key"].to_numpy(zero_copy_only=False), b["text_hash"].to_numpy(zero_copy_only=False)
            texts = [np.frombuffer(t, dtype=np.uint8) for t in b["text"].to_pylist()]
            for doc, start, count, least, content, twice in scan_runs(texts, length, gram, lambda x: _LIFT[x]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least.view(np.int64)), pa.array(content.view(np.int64)), pa.array(key[doc]), pa.array(th[doc]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(twice)],
                    names=["h", "c", "key", "text_hash", "start", "n", "twice"],
                )

    return run


def _sorted_rotations(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of a symbol sequence, ordered by at least their first ``depth`` symbols, by prefix doubling."""
    used, symbols = np.unique(symbols, return_inverse=True)
    bits = max(1, int(len(used) - 1).bit_length())
    n, h = len(symbols), 63 // bits
    packed = np.zeros(n, dtype=np.int64)
    for i in range(h):
        packed = (packed << bits) | np.roll(symbols, -i)
    order = np.argsort(packed)
    ordered = packed[order]
    group = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))  # by place in the order
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    while h < depth:
        tied = np.zeros(n + 1, dtype=bool)  # only rotations that are not yet alone in their group are sorted on
        tied[1:n] = group[1:] == group[:-1]
        places = np.flatnonzero(tied[:-1] | tied[1:])
        if not len(places):
            break
        at = order[places]
        packed = group[places] * n + rank[(at + h) % n]
        sort = np.argsort(packed)
        order[places], ordered = at[sort], packed[sort]
        new = np.zeros(n, dtype=np.int64)
        new[1:] = group[1:] != group[:-1]
        new[places[1:]] |= ordered[1:] != ordered[:-1]
        group = np.cumsum(new)
        rank[order] = group
        h *= 2
    return order


def _open_boundaries(order: np.ndarray, symbols: np.ndarray, depth: int) -> np.ndarray:
    """For each place i of the order: do rotations i-1 and i share ``depth`` symbols or more?"""
    n = len(order)
    bwt = symbols[order - 1].astype(np.uint16)
    back = np.empty(n, dtype=np.int64)  # the place of the rotation that begins one symbol earlier
    by_symbol = np.argsort(bwt, kind="stable")
    back[by_symbol] = np.arange(n)
    first = bwt[by_symbol]
    is_open = np.ones(n + 1, dtype=bool)
    lo, hi = np.zeros(1, dtype=np.int64), np.full(1, n - 1)
    for _ in range(depth):
        if not len(lo):
            break
        size = hi - lo + 1
        owner = np.repeat(np.arange(len(lo)), size)
        to = back[np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)]
        at = np.argsort(to)
        to, owner = to[at], owner[at]
        edge = np.flatnonzero((owner[1:] != owner[:-1]) | (first[to[1:]] != first[to[:-1]]))
        lo, hi = to[np.concatenate([[0], edge + 1])], to[np.append(edge, len(to) - 1)]
        new = is_open[hi + 1]
        lo, hi = lo[new], hi[new]
        is_open[hi + 1] = False
    is_open[0] = False
    return is_open[:n]


def repeated_starts(contents: list[bytes], weights: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each content, the stretches [a, b) of starts of ``length``-byte strings that occur twice or more in all.

    A content of weight w stands for w equal pieces of text.
    """
    sizes = np.array([len(c) + 1 for c in contents])
    symbols = np.concatenate([x for c in contents for x in (np.frombuffer(c, dtype=np.uint8).astype(np.int64) + 1, np.zeros(1, dtype=np.int64))])
    end = np.cumsum(sizes)
    order = _sorted_rotations(symbols, length)
    shared = _open_boundaries(order, symbols, length)
    of = np.repeat(np.arange(len(contents)), sizes)
    weight = np.where(np.arange(len(symbols)) + length < end[of], weights[of], 0)
    heads = np.flatnonzero(~shared)
    total = np.add.reduceat(weight[order], heads)
    hit = np.zeros(len(symbols) + 1, dtype=bool)
    hit[order] = np.repeat(total >= 2, np.diff(np.append(heads, len(order))))
    hit[:-1] &= weight > 0
    step = np.diff(hit.astype(np.int8), prepend=0)
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = np.searchsorted(a, end - sizes), np.searchsorted(a, end)
    return [(a[i:j] - base, b[i:j] - base) for i, j, base in zip(*cut, end - sizes)]


def _shard(length: int):
    def run(t: pa.Table) -> pa.Table:
        spans = repeated_starts(t["bytes"].to_pylist(), t["weight"].to_numpy(), length)
        k = np.repeat(np.arange(len(spans)), [len(a) for a, _ in spans])
        a, b = (np.concatenate([x[i] for x in spans]).astype(np.int32) for i in (0, 1))
        return pa.table({"h": t["h"].to_numpy()[k], "c": t["c"].to_numpy()[k], "a": a, "b": b})

    return run


def _contents(length: int):
    """The asked stretches of a document as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, asks in zip(b["text"].to_pylist(), b["asks"].to_pylist()):
                cols = {k: [x[k] for x in asks] for k in ("h", "c", "weight", "hot")}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols["h"], pa.int64()), pa.array(cols["c"], pa.int64()), pa.array(cols["weight"], pa.int64()), pa.array(cols["hot"], pa.bool_()), pa.array([text[x["start"] : x["start"] + x["n"] + length - 1] for x in asks], pa.binary())],
                    names=["h", "c", "weight", "hot", "bytes"],
                )

    return run


def _each_window(length: int):
    """Single windows of hot contents: content, place in it, and the window's two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, c, weight = (b[k].to_numpy(zero_copy_only=False) for k in ("h", "c", "weight"))
            texts = [np.frombuffer(x, dtype=np.uint8) for x in b["bytes"].to_pylist()]
            for doc, start, n, least, _, _ in scan_runs(texts, length, length, lambda x: _LIFT[x]):
                doc, start, least = (np.repeat(x, n) for x in (doc, start, least))
                start = start + np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(h[doc]), pa.array(c[doc]), pa.array(start.astype(np.int32)), pa.array(least.view(np.int64)), pa.array(weight[doc])], names=["h", "c", "a", "w", "weight"])

    return run


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``(key, text_hash, start, end)``: byte spans covered by strings of ``length`` bytes that start in two places."""
    kind = "h long, c long, key long, text_hash long, start int, n int, twice boolean"
    runs = materialize(docs.where(F.length("text") >= length).select("key", "text_hash", "text").mapInArrow(_stretches(length, min(gram, length)), kind))
    seen = runs.groupBy("h").agg(F.count("*").alias("places"), F.max("twice").alias("inside"), (F.min("c") != F.max("c")).alias("mixed")).where("places > 1 or inside")
    found = materialize(runs.drop("twice").join(seen.select("h", (F.col("mixed") | (F.col("places") == 1)).alias("open")), "h"))
    # one content in several places: its interval is itself with its weight, nothing is left to expand
    whole = found.where("not open").select("key", "text_hash", "start", (F.col("start") + F.col("n") + length - 1).alias("end"))
    hit = found.where("open").drop("open")
    contents = hit.groupBy("h", "c").agg(F.count("*").alias("weight"), F.min(F.struct("key", "text_hash", "start", "n")).alias("f"))
    contents = materialize(contents.select("h", "c", "weight", "f.*"))
    size = F.col("n") + length
    hot = contents.groupBy("h").agg(F.sum(size).alias("s")).where(F.col("s") > hot_bytes).select("h", F.lit(True).alias("hot"))
    asks = contents.join(hot, "h", "left").select("h", "c", "weight", "key", "text_hash", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))
    asks = asks.groupBy("key", "text_hash").agg(F.collect_list(F.struct("start", "n", "h", "c", "weight", "hot")).alias("asks"))
    pieces = docs.select("key", "text_hash", "text").join(asks, ["key", "text_hash"]).select("text", "asks").mapInArrow(_contents(length), "h long, c long, weight long, hot boolean, bytes binary")
    total = contents.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    pieces = materialize(pieces)
    shards = max(1, total // shard_bytes)
    spans = pieces.where("not hot").groupBy(F.pmod("h", F.lit(shards)).alias("shard")).applyInArrow(_shard(length), "h long, c long, a int, b int")
    single = materialize(pieces.where("hot").mapInArrow(_each_window(length), "h long, c long, a int, w long, weight long"))
    again = single.groupBy("h", "w").agg(F.sum("weight").alias("s")).where("s > 1").select("h", "w")
    spans = spans.union(single.join(again, ["h", "w"]).select("h", "c", "a", (F.col("a") + 1).alias("b")))
    return whole.union(hit.join(spans, ["h", "c"]).select("key", "text_hash", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b") + length - 1).alias("end")))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for text, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist()):
            s, e = merged(np.array([x["start"] for x in spans or ()], dtype=np.int64), np.array([x["end"] for x in spans or ()], dtype=np.int64))
            kept = b"".join(text[i:j] for i, j in zip([0, *e.tolist()], [*s.tolist(), len(text)]))
            for col, v in zip(out, (len(text), int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), kept)):
                col.append(v)
        yield pa.RecordBatch.from_arrays([b["row"], *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, length: int = 200, carry: list[str] | None = None, **sizes: int) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    ``docs`` has ``doc_id`` (long) and ``text``; further columns are carried in ``row`` if named. One result row
    per input row: ``row, n_bytes, n_removed, n_spans, kept_sha256, kept`` (``kept``: the remaining bytes).

    Defined cases: a null text is empty; matches never cross rows; a string counts as repeated when it starts twice
    in one text or in two rows, also rows with equal or null ids; texts shorter than ``length`` lose nothing; an empty
    table gives no rows.
    """
    d = keyed(docs, carry)
    kind = d.schema["row"].dataType.simpleString()
    full = spans_joined(d, repeated_spans(d, length, **sizes)).select("row", "text", "spans")
    return full.mapInArrow(_kept, f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
