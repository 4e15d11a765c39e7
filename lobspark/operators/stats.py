"""Exact quantiles and distribution summaries that stay distributed for hot groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.operators.ordered import running
from lobspark.session import materialize


#: Value ranges into which each group's distinct values are cut.
PARTS = 64


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    probs: Mapping[str, float],
) -> DataFrame:
    """Linear-interpolated exact quantiles per key, wide: one ``{value}_{prob}`` column each.

    Values are counted first (map-side combine), then ranked with the two-phase running sum over value ranges cut at
    approximate quantiles of the group's own distinct values: no task holds a group, however close its values
    are. The cuts only place rows, ranks are exact. Null and NaN values are ignored.
    """
    keys = list(keys)
    if not keys:
        df, keys, drop = df.withColumn("__one", F.lit(0)), ["__one"], True
    else:
        drop = False
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("m"), c.cast("double").alias("v")) for n, c in values.items()])
        ).alias("x"),
    ).select(*keys, F.col("x.m").alias("__m"), F.col("x.v").alias("__v"))
    counts = materialize(
        long.filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
        .groupBy(*keys, "__m", "__v")
        .agg(F.count("*").alias("__n"))
    )
    out = ranked_quantiles(counts, keys, {n: probs for n in values})
    return out.drop("__one") if drop else out


def ranked_quantiles(counts: DataFrame, keys: Sequence[str], wanted: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """The second half of ``quantiles``, for whoever has the counts: ``keys, __m`` (name of the value), ``__v, __n``, each value once.

    The cuts are stored: approximate quantiles depend on the order in which partial results arrive, and the running sum reads its input twice.
    """
    keys = list(keys)
    cuts = F.percentile_approx("__v", [i / PARTS for i in range(1, PARTS)], 20 * PARTS)
    groups = materialize(counts.groupBy(*keys, "__m").agg(cuts.alias("__cuts"), F.sum("__n").alias("__tot")))
    part = F.size(F.filter("__cuts", lambda e: e <= F.col("__v"))).cast("bigint")
    placed = counts.join(groups, [*keys, "__m"]).withColumn("__b", part).drop("__cuts")
    both = running(placed, [*keys, "__m"], ["__b", "__v"], {"__cum": ("sum", F.col("__n"))}, width=1)
    before = F.col("__cum") - F.col("__n")
    aggs = []
    for n, probs in wanted.items():
        for p, q in probs.items():
            h = (F.col("__tot") - 1) * F.lit(float(q))
            lo, hi = F.floor(h), F.ceil(h)
            m = F.col("__m") == n
            aggs.append(F.max(F.when(m & (before <= lo) & (lo < F.col("__cum")), F.col("__v"))).alias(f"__lo_{n}_{p}"))
            aggs.append(F.max(F.when(m & (before <= hi) & (hi < F.col("__cum")), F.col("__v"))).alias(f"__hi_{n}_{p}"))
            aggs.append(F.max(F.when(m, h - lo)).alias(f"__f_{n}_{p}"))
    wide = both.groupBy(*keys).agg(*aggs)
    out = []
    for n, probs in wanted.items():
        for p in probs:
            lo, hi, f = F.col(f"__lo_{n}_{p}"), F.col(f"__hi_{n}_{p}"), F.col(f"__f_{n}_{p}")
            out.append(F.when(lo == hi, lo).otherwise(lo * (1 - f) + hi * f).alias(f"{n}_{p}"))  # as the SQL weighs two values
    return wide.select(*keys, *out)


SUMMARY_PROBS = {"median": 0.5, "p95": 0.95, "p99": 0.99}


def abs_stats(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """``n, median, mean, p95, p99, max`` of the finite values of each metric, long by ``metric``."""
    keys = list(keys)
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("m"), c.cast("double").alias("v")) for n, c in values.items()])
        ).alias("x"),
    ).select(*keys, F.col("x.m").alias("metric"), F.col("x.v").alias("v"))
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))
    v = F.when(finite, F.col("v"))
    base = long.groupBy(*keys, "metric").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max"))
    q = quantiles(long.filter(finite), [*keys, "metric"], {"v": F.col("v")}, SUMMARY_PROBS)
    out = base.join(q, [*keys, "metric"], "left")
    return out.select(
        *keys,
        "metric",
        "n",
        F.col("v_median").alias("median"),
        "mean",
        F.col("v_p95").alias("p95"),
        F.col("v_p99").alias("p99"),
        "max",
    )
