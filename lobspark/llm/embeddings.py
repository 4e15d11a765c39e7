"""Embedding near-dedup by collision-counting projections.

Every vector is projected on many random lines. A pair collides on a line when one value lies in the window around the other
(half-width ``w``). Pairs at the wanted cosine collide on nearly all lines, unrelated pairs on few; a pair is verified
with its exact cosine when its count of collisions reaches a threshold, chosen from the binomial law so that a pair
at the wanted cosine is missed with probability ``miss`` at most.

Scale: counting every pair would be quadratic. Tables of a few sorted lines, each cut at its middle, deal the vectors
into cells; a pair is counted in the first table in which both have the same cell. The lines per table grow
with the logarithm of the number of vectors, and the number of tables follows from the wanted recall. Equal vectors
are one class with a weight, so copies are never compared. A cell beyond ``BLOCK`` classes becomes blocks; each pair of
blocks is a task's work of bounded size. Counts and spanning links leave a task, never its pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.llm.common import components
from lobspark.session import materialize

#: Lines on which collisions are counted; vectors in a cell that are compared at once.
LINES, BLOCK = 32, 1024
#: Wanted share of pairs at exactly the threshold that meet in a cell, and the share that the count may miss.
MEET, MISS = 0.97, 0.005
CELL = 200


@lru_cache(maxsize=4)
def _lines(dim: int, n: int, seed: int) -> np.ndarray:
    x = np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, n))
    return x


def window_and_count(cosine: float, lines: int, miss: float) -> tuple[float, int]:
    """Half-width of the window, and the collisions that a pair at the cosine reaches with probability 1 - miss."""
    sigma = math.sqrt(max(2 - 2 * cosine, 1e-12))
    p = math.erf(1.5 / math.sqrt(2))  # half-width of one and a half deviations
    tail, k = 0.0, 0
    while k < lines:
        tail += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if tail > miss:
            break
        k += 1
    return 1.5 * sigma, k


def tables(n: int, cosine: float, meet: float = MEET) -> tuple[int, int]:
    """Lines per table and number of tables for n vectors."""
    per = min(24, max(1, round(math.log2(max(2, n) / CELL))))
    same = (1 - math.acos(min(1.0, cosine)) / math.pi) ** per
    return per, max(1, math.ceil(math.log(1 - meet) / math.log(1 - min(same, 1 - 1e-9))))


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _cells(per: int, many: int):
    def run(batches):
        for b in batches:
            x = _unit(np.array(b["v"].to_pylist(), dtype=np.float64))
            side = (x @ _lines(x.shape[1], per * many, 1)).reshape(len(x), many, per) > 0
            cells = (side * (1 << np.arange(per))).sum(axis=2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(list(cells), pa.list_(pa.int32()))], names=["id", "v", "cells"])

    return run


def _block_pairs(cosine: float):
    width, least = window_and_count(cosine, LINES, MISS)

    def run(t: pa.Table) -> pa.Table:
        table = t["t"][0].as_py()
        ids, role = t["id"].to_numpy(), t["right"].to_numpy()
        weight = t["weight"].to_numpy()
        x = _unit(np.array(t["v"].to_pylist(), dtype=np.float64))
        values = (x @ _lines(x.shape[1], LINES, 2)).astype(np.float32)
        cells = np.array(t["cells"].to_pylist(), dtype=np.int32)
        same_block = t["same"][0].as_py()
        a = np.flatnonzero(~role) if not same_block else np.arange(len(ids))
        b = np.flatnonzero(role) if not same_block else a
        count, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        links = []
        for at in range(0, len(a), 128):
            some = a[at : at + 128]
            hits = np.zeros((len(some), len(b)), dtype=np.int16)
            for k in range(LINES):
                hits += np.abs(values[some, k][:, None] - values[b, k][None, :]) <= width
            i, j = np.nonzero(hits >= least)
            i, j = some[i], b[j]
            keep = ids[i] < ids[j] if same_block else np.ones(len(i), dtype=bool)
            keep &= (cells[i, :table] != cells[j, :table]).all(axis=1)  # not met in an earlier table
            i, j = i[keep], j[keep]
            for q in range(0, len(i), 1 << 16):
                u, v = i[q : q + (1 << 16)], j[q : q + (1 << 16)]
                near = (x[u] * x[v]).sum(axis=1) >= cosine
                u, v = u[near], v[near]
                np.add.at(count, u, weight[v])
                np.add.at(count, v, weight[u])
                for m, n in zip(u.tolist(), v.tolist()):
                    m, n = root(m), root(n)
                    if m != n:
                        parent[m] = n
                        links.append((m, n))
        hit = np.flatnonzero(count)
        la, lb = (ids[[p[k] for p in links]] if links else np.zeros(0, dtype=np.int64) for k in (0, 1))
        none = np.zeros(len(links), dtype=np.int64)
        return pa.table({"id": np.concatenate([ids[hit], la]), "n": np.concatenate([count[hit], none]), "other": pa.array([None] * len(hit) + lb.tolist(), pa.int64())})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id`` long, ``embedding`` array).

    A link is a cosine of at least ``cosine`` in double precision, found with the recall set by ``MEET`` and ``MISS``.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths do not link; repeated rows link with each other; a null ``vec_id`` never names a
    component unless no other id does; an empty table gives no rows.
    """
    v = F.col("embedding").cast("array<double>")
    fit = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    # classes by direction would need rounding: only equal vectors are one class
    rows = materialize(vectors.select("vec_id", F.when(fit, v).alias("v")).withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v"))))
    classes = rows.where("v is not null").groupBy("h", "v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    classes = materialize(classes.select(F.xxhash64(F.lit(7), "v").alias("h2"), "h", "v", "weight", "first").withColumn("id", F.col("h").bitwiseXOR(F.shiftleft("h2", 1))))
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("v")).count().collect()}  # a row for each vector length
    parts = []
    for dim, n in sizes.items():
        per, many = tables(n, cosine)
        dealt = classes.where(F.size("v") == dim)
        cells = dealt.select("id", "v").mapInArrow(_cells(per, many), "id long, v array<double>, cells array<int>").join(dealt.select("id", "weight"), "id")
        cells = materialize(cells)
        each = cells.select("id", "weight", F.posexplode("cells").alias("t", "cell"))
        full = each.groupBy("t", "cell").agg(F.count("*").alias("size")).where("size > 1").select("t", "cell", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
        placed = each.drop("weight").join(full, ["t", "cell"]).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
        pairs = placed.select("id", "t", "cell", "b", other).select("id", "t", "cell", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), (F.col("b") > F.col("o")).alias("right"), (F.col("b") == F.col("o")).alias("own"))
        # a block meets itself in (b, b); in (lo, hi) its rows are left or right
        work = pairs.withColumn("same", F.col("lo") == F.col("hi")).join(cells, "id")
        parts.append(work.groupBy("t", "cell", "lo", "hi").applyInArrow(_block_pairs(cosine), "id long, n long, other long"))
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = materialize(found)
    counts = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    comp = materialize(components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))))
    named = comp.join(classes.select(F.col("id").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("name"))
    linked = comp.join(named, "component").select(F.col("node").alias("id"), "name")
    info = classes.join(counts, "id", "left").join(linked, "id", "left").select("h", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("name", "first").alias("name"))
    out = rows.join(info, ["h", "v"], "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("name"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
