"""Shared shapes: reading tables, keys that survive repeated ids, rolling hashes, connected components."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.session import materialize

#: Stands for a null doc_id in keys; it orders before every real id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``(row, key, text_hash, text)`` with the text as bytes (null: empty) and the columns to carry in ``row``.

    ``(key, text_hash)`` finds a row again: rows that share both have equal texts, so whatever is decided for
    one of them holds for the others. A null ``doc_id`` gets the smallest key. Columns that are not carried are
    left out, so that no name can clash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in (carry or ["doc_id"])]).alias("row")
    return docs.select(row, F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).cast("long").alias("key"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def spans_joined(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every keyed row with the spans ``(start, end)`` found for it; a row's spans are bounded by its own text."""
    lists = spans.groupBy("key", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return docs.join(lists, ["key", "text_hash"], "left")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that order and equality of values carry no trace of the text's order."""
    x = x.copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    inverse = pow(base, -1, 2**64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Rolling:
    """Polynomial hashes (modulo 2**64) of any stretch of a symbol sequence, from prefix sums."""

    def __init__(self, symbols: np.ndarray, base: int):
        n = len(symbols)
        self.up, down = _powers(base, 1 << max(16, n.bit_length()))
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.add.accumulate(symbols * down[:n], out=self.prefix[1:])

    def windows(self, k: int) -> np.ndarray:
        n = len(self.prefix) - 1
        return mix((self.prefix[k:] - self.prefix[:-k]) * self.up[k - 1 : n])

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.up[end - 1] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def window_runs(symbols: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Stretches of consecutive windows of ``length`` symbols whose smallest ``gram`` hash is the same.

    ``bounds`` cuts the concatenated documents; no window crosses a bound. Equal windows have equal smallest
    hashes, so all places of a repeated window are found under one hash. Gives document number, start in the
    concatenation, number of windows, the smallest hash, a hash of the stretch's whole content, and whether the
    smallest hash has two places in the stretch, as it must where a window is repeated inside it.
    """
    grams, w = Rolling(symbols, 0x9E3779B97F4A7C15).windows(gram), length - gram + 1
    least = sliding_min(grams, w)
    n = len(least)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ok = doc[:n] == doc[length - 1 : length - 1 + n]
    new = np.ones(n, dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:n] != doc[: n - 1]) | (ok[1:] != ok[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    keep = ok[start]
    start, count = start[keep], count[keep]
    content = Rolling(symbols, 0xC2B2AE3D27D4EB4F).stretches(start, start + count + length - 1)
    seen = np.lib.stride_tricks.sliding_window_view(grams, w)
    last = start + count - 1
    twice = start + seen[start].argmin(axis=1) != last + w - 1 - seen[last][:, ::-1].argmin(axis=1)
    return doc[start], start, count, least[start], content, twice


def chunks(sizes: list[int], most: int):
    """Slices of consecutive items of about ``most`` in sum; a larger item stands alone."""
    at, total = 0, 0
    for i, s in enumerate(sizes):
        if i > at and total + s > most:
            yield at, i
            at, total = i, 0
        total += s
    if at < len(sizes):
        yield at, len(sizes)


def scan_runs(sequences: list[np.ndarray], length: int, gram: int, lift=lambda x: x, most: int = 400_000):
    """``window_runs`` of many sequences, some at a time; a very long one goes in pieces that overlap by a window.

    Gives, for each group: sequence number, start in the sequence, and the rest of what ``window_runs`` gives.
    """
    pieces = [(d, at) for d, s in enumerate(sequences) if len(s) >= length for at in range(0, len(s) - length + 1, most)]
    cut = [sequences[d][at : at + most + length - 1] for d, at in pieces]
    for i, j in chunks([len(x) for x in cut], most):
        doc, start, *rest = window_runs(lift(np.concatenate(cut[i:j])), bounds := np.cumsum([0, *map(len, cut[i:j])]), length, gram)
        number, offset = (np.array(x) for x in zip(*pieces[i:j]))
        yield number[doc], start - bounds[doc] + offset[doc], *rest


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open spans; touching spans join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], s[1:] > e[:-1]])
    return s[first], e[np.append(np.flatnonzero(first)[1:] - 1, len(s) - 1)]


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the long pairs ``(a, b)``; component is the smallest node reachable.

    Alternates large-star and small-star steps. Each step is two joins or groupings by node, written to the
    shared folder; the number of steps grows with the logarithm of the longest path. A node with very many
    links is an ordinary skewed join key here, never a collected group. No edges: no rows.
    """
    cur = materialize(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct())
    seen = None
    while True:
        both = cur.union(cur.select("u", "v")).toDF("x", "y")
        low = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("m").alias("v"), F.col("y").alias("u"))
        large = materialize(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("m").alias("v"), F.explode(F.array("u", "v")).alias("u")).where("u <> v").distinct()
        cur = materialize(small)
        state = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select("v", "v").distinct())
