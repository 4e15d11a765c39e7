"""Ordered scans, as-of joins and range joins that never put one key into one task.

A window over ``partitionBy(symbol)`` sends all rows of a symbol to a single task, and one symbol
may own a third of the data. Every scan here is two-phase instead: rows are windowed inside
``(keys, time bucket)``, one summary row per bucket is prefix-scanned over the (few) buckets of a
key, and the carry is joined back. The fact rows shuffle on ``(keys, bucket)`` only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lobspark.session import DAY_NS, HOUR_NS

BUCKET = "__bucket"


def bucket_of(ts: str, width: int) -> Column:
    """Integer time bucket of a BIGINT column (exact: no double division)."""
    return F.expr(f"`{ts}` div {int(width)}L")


def with_bucket(df: DataFrame, ts: str, width: int) -> DataFrame:
    return df.withColumn(BUCKET, bucket_of(ts, width))


def balanced_bucket_width(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    max_rows: int,
    widths: Sequence[int] = (DAY_NS, DAY_NS // 24, DAY_NS // 144, DAY_NS // 1440, DAY_NS // 86_400),
) -> int:
    """Widest bucket width whose fullest ``(keys, bucket)`` stays under ``max_rows``.

    The widest is tried first, by one count of few groups. Only if it is too wide, one aggregation at the finest width follows; the other
    widths are rolled up from its counts. One row comes back to the driver.
    """
    finest, widest = min(widths), max(widths)
    top = df.groupBy(*keys, bucket_of(ts, widest)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if top is None or top <= max_rows:
        return widest
    cells = df.groupBy(*keys, bucket_of(ts, finest).alias("__c")).agg(F.count("*").alias("__n"))
    tops = []
    for w in sorted(set(widths) - {widest}, reverse=True):
        rolled = cells.groupBy(*keys, F.expr(f"`__c` div {w // finest}L").alias("__r")).agg(
            F.sum("__n").alias("__n")
        )
        tops.append(rolled.agg(F.max("__n").alias("top")).withColumn("w", F.lit(w)))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    best = out.filter(F.col("top") <= max_rows).agg(F.max("w")).first()[0]
    return int(best) if best is not None else finest


#: Rows that a task sorts at a time where ``dealt`` places them.
TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as keep a task at about ``TASK_ROWS``, never fewer than the session's: what a task holds does
    not grow with the table. ``rows``: their number, counted if not given."""
    n = df.count() if rows is None else rows
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
    return df.repartition(parts, *keys)


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn("__all", F.lit(0)), ["__all"]


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: Mapping[str, tuple[str, Column]],
    *,
    width: int = HOUR_NS,
    inclusive: bool = True,
    reverse: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Running ``sum | max | min | last`` per key in ``order`` (first entry is the BIGINT time).

    ``last`` keeps the last non-null value. ``inclusive=False`` excludes the current row;
    ``reverse=True`` scans from the end. A null result means nothing came before. ``rows``, if known, sizes the partitions (``dealt``).
    """
    df, k = _keyed(df, keys)
    df = with_bucket(df, order[0], width)
    df = df if rows is None else dealt(df, *k, BUCKET, rows=rows)
    cols = df.columns
    tmp = {f"__v_{n}": c for n, (_, c) in aggs.items()}
    df = df.withColumns(tmp)

    ordering = [F.desc(c) if reverse else F.asc(c) for c in order]
    edge = W.currentRow if inclusive else -1
    local = W.partitionBy(*k, BUCKET).orderBy(*ordering).rowsBetween(W.unboundedPreceding, edge)
    carry = (
        W.partitionBy(*k)
        .orderBy(F.desc(BUCKET) if reverse else F.asc(BUCKET))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    fn = {"sum": F.sum, "max": F.max, "min": F.min}
    key = _order_struct(order)
    pick = F.min_by if reverse else F.max_by

    summary_aggs, carry_cols, local_cols = [], [], {}
    for n, (kind, _) in aggs.items():
        v = F.col(f"__v_{n}")
        if kind == "last":
            summary_aggs.append(pick(F.when(v.isNotNull(), v), F.when(v.isNotNull(), key)).alias(f"__s_{n}"))
            carry_cols.append(F.last(f"__s_{n}", ignorenulls=True).over(carry).alias(f"__c_{n}"))
            local_cols[n] = F.last(v, ignorenulls=True).over(local)
        else:
            summary_aggs.append(fn[kind](v).alias(f"__s_{n}"))
            carry_cols.append(fn[kind](f"__s_{n}").over(carry).alias(f"__c_{n}"))
            local_cols[n] = fn[kind](v).over(local)

    summary = df.groupBy(*k, BUCKET).agg(*summary_aggs).select(*k, BUCKET, *carry_cols)
    local_df = df.withColumns({f"__l_{n}": c for n, c in local_cols.items()})
    out = local_df.join(summary, [*k, BUCKET], "left")

    final = {}
    for n, (kind, _) in aggs.items():
        here, before = F.col(f"__l_{n}"), F.col(f"__c_{n}")
        if kind == "sum":
            final[n] = F.when(here.isNull(), before).when(before.isNull(), here).otherwise(here + before)
        elif kind == "max":
            final[n] = F.greatest(here, before)
        elif kind == "min":
            final[n] = F.least(here, before)
        else:
            final[n] = F.coalesce(here, before)
    keep = [c for c in cols if c not in (BUCKET, "__all") and c not in aggs]
    return out.select(*keep, *[c.alias(n) for n, c in final.items()])


def shift(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Mapping[str, Column],
    *,
    width: int = HOUR_NS,
    lead: bool = False,
) -> DataFrame:
    """``lag`` (or ``lead``) by one row across bucket borders; outputs named by ``cols``."""
    df, k = _keyed(df, keys)
    df = with_bucket(df, order[0], width)
    orig = [c for c in df.columns if c not in (BUCKET, "__all") and c not in cols]
    df = df.withColumn("__v", F.struct(*[c.alias(n) for n, c in cols.items()]))
    local = W.partitionBy(*k, BUCKET).orderBy(*order)
    moved = F.lead("__v").over(local) if lead else F.lag("__v").over(local)
    key = _order_struct(order)
    edge = F.min_by("__v", key) if lead else F.max_by("__v", key)
    carry = W.partitionBy(*k).orderBy(BUCKET)
    summary = (
        df.groupBy(*k, BUCKET)
        .agg(edge.alias("__e"))
        .select(*k, BUCKET, (F.lead("__e") if lead else F.lag("__e")).over(carry).alias("__c"))
    )
    out = df.withColumn("__m", moved).join(summary, [*k, BUCKET], "left")
    v = F.coalesce("__m", "__c")
    return out.withColumn("__r", v).select(*orig, *[F.col(f"__r.{n}").alias(n) for n in cols])


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    state: Sequence[Column],
    *,
    width: int = HOUR_NS,
    name: str = "island",
) -> DataFrame:
    """Number maximal runs of rows with equal (null-safe) ``state``, counting from 0 per key.

    One pass: a bucket is summarised by its first state, last state and inner changes.
    """
    df, k = _keyed(df, keys)
    df = with_bucket(df, order[0], width)
    orig = [c for c in df.columns if c not in (BUCKET, "__all", name)]
    df = df.withColumn("__cur", F.struct(*[c.alias(f"s{i}") for i, c in enumerate(state)]))
    w = W.partitionBy(*k, BUCKET).orderBy(*order)
    prev = F.lag("__cur").over(w)
    df = df.withColumn("__chg", F.when(prev.isNull(), 0).otherwise((~prev.eqNullSafe(F.col("__cur"))).cast("int")))
    local = df.withColumn("__n", F.sum("__chg").over(w.rowsBetween(W.unboundedPreceding, 0)))
    key = _order_struct(order)
    per = df.groupBy(*k, BUCKET).agg(
        F.min_by("__cur", key).alias("__f"), F.max_by("__cur", key).alias("__l"), F.sum("__chg").alias("__s")
    )
    wb = W.partitionBy(*k).orderBy(BUCKET)
    per = per.withColumn("__p", F.lag("__l").over(wb)).withColumn(
        "__edge", F.when(F.col("__p").isNull(), 0).otherwise((~F.col("__p").eqNullSafe(F.col("__f"))).cast("int"))
    )
    carry = F.sum(F.col("__s") + F.col("__edge")).over(wb.rowsBetween(W.unboundedPreceding, 0)) - F.col("__s")
    per = per.select(*k, BUCKET, carry.alias("__c"))
    return local.join(per, [*k, BUCKET], "left").select(
        *orig, (F.col("__n") + F.col("__c")).cast("bigint").alias(name)
    )


def rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, width: int = HOUR_NS, name: str = "rn"
) -> DataFrame:
    """1-based row number per key in a total order, without a single-task window."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, width=width)


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    left_ts: str,
    right_ts: str,
    right_order: Sequence[str] = (),
    cols: Mapping[str, Column],
    width: int = HOUR_NS,
    strict: bool = False,
) -> DataFrame:
    """Backward as-of join: each left row gets the last right row with ``right_ts <= left_ts``.

    Union + running last: linear in both inputs, no range join. ``strict`` uses ``<``.
    """
    lcols = left.columns
    n = len(right_order)
    l_in = left.select(
        *keys,
        F.col(left_ts).alias("__t"),
        F.lit(0 if strict else 1).alias("__side"),
        *[F.lit(None).cast("bigint").alias(f"__o{i}") for i in range(n)],
        F.struct(*[F.col(c) for c in lcols]).alias("__left"),
        F.lit(None).alias("__dummy"),
    )
    payload = F.struct(*[c.alias(k) for k, c in cols.items()])
    r_in = right.select(
        *keys,
        F.col(right_ts).alias("__t"),
        F.lit(1 if strict else 0).alias("__side"),
        *[F.col(c).cast("bigint").alias(f"__o{i}") for i, c in enumerate(right_order)],
        payload.alias("__right"),
    )
    both = l_in.drop("__dummy").unionByName(r_in, allowMissingColumns=True)
    order = ["__t", "__side", *[f"__o{i}" for i in range(n)]]
    out = running(both, keys, order, {"__hit": ("last", F.col("__right"))}, width=width)
    return out.filter(F.col("__left").isNotNull()).select(
        *[F.col(f"__left.`{c}`").alias(c) for c in lcols],
        *[F.col(f"__hit.{k}").alias(k) for k in cols],
    )


def range_join(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    *,
    point_lo: str,
    point_hi: str,
    span_lo: str,
    span_hi: str,
    width: int,
    how: str = "inner",
    condition: Column | None = None,
) -> DataFrame:
    """Join rows whose closed ranges ``[point_lo, point_hi]`` and ``[span_lo, span_hi]`` meet.

    Both sides are cut into time buckets and equi-joined on ``(keys, bucket)``; a pair meeting in
    several buckets is kept only in the bucket where the later of the two starts, so nothing is
    counted twice. Column names must be disjoint apart from ``keys``.
    """
    b = f"{BUCKET}_j"

    def cut(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.filter(F.col(hi) >= F.col(lo)).withColumn(
            b, F.explode(F.sequence(bucket_of(lo, width), bucket_of(hi, width)))
        )

    hit = (
        (F.col(point_lo) <= F.col(span_hi))
        & (F.col(span_lo) <= F.col(point_hi))
        & (F.expr(f"greatest(`{point_lo}`, `{span_lo}`) div {int(width)}L") == F.col(b))
    )
    if condition is not None:
        hit = hit & condition
    inner = cut(points, point_lo, point_hi).join(cut(spans, span_lo, span_hi), [*keys, b]).filter(hit).drop(b)
    if how == "inner":
        return inner
    if how in ("left_semi", "left_anti"):
        # null-safe on every column: a null in a column that is not a key must not hide a hit
        found = inner.select(*[F.col(c).alias(f"__hit_{c}") for c in points.columns]).distinct()
        same = [points[c].eqNullSafe(found[f"__hit_{c}"]) for c in points.columns]
        return points.join(found, same, how)
    raise ValueError(f"unsupported range join kind {how!r}")
