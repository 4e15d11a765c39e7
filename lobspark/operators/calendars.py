"""Coverage calendars: presence, gaps, usable intersections, routing, batching, sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def presence_days(rows: DataFrame, feed: str, dt: str = "dt") -> DataFrame:
    return rows.select(F.col(feed).alias("feed"), F.col(dt).alias("dt")).distinct()


def day_range(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(lo, hi, F.expr("interval 1 day")))


def full_calendar(presence: DataFrame) -> DataFrame:
    """Every feed × every day between the first and last day seen anywhere."""
    span = presence.agg(F.min("dt").alias("lo"), F.max("dt").alias("hi"))
    days = span.select(day_range(F.col("lo"), F.col("hi")).alias("dt"))
    return presence.select("feed").distinct().crossJoin(days)  # feeds × calendar days: metadata, not rows


def coverage_gaps(presence: DataFrame) -> DataFrame:
    """Per feed: days present, days in range, and missing days."""
    cal = full_calendar(presence)
    x = cal.join(presence.withColumn("here", F.lit(1)), ["feed", "dt"], "left")
    return x.groupBy("feed").agg(
        F.count("here").alias("n_present"), F.count("*").alias("n_total"), (F.count("*") - F.count("here")).alias("n_missing")
    )


def missing_days(presence: DataFrame) -> DataFrame:
    return full_calendar(presence).join(presence, ["feed", "dt"], "left_anti")


def day_runs(days: DataFrame, keys: Sequence[str], min_len: int = 1) -> DataFrame:
    """Runs of consecutive days with their length."""
    n = F.datediff("dt", F.lit("1970-01-01").cast("date"))
    g = days.withColumn("__g", n - F.row_number().over(W.partitionBy(*keys).orderBy("dt")))
    r = g.groupBy(*keys, "__g").agg(F.min("dt").alias("first_day"), F.max("dt").alias("last_day"), F.count("*").alias("n_days"))
    return r.filter(F.col("n_days") >= min_len).drop("__g")


def usable_calendar(presence: DataFrame, required: Sequence[str], fillable: Mapping[str, str], lo: Column, hi: Column) -> DataFrame:
    """One row per calendar day: usable (all required feeds), complete, fill needs, exclusion reasons.

    ``fillable`` maps a product (book, trades) to the feed a second vendor may supply.
    """
    feeds = [*required, *fillable.values()]
    span = presence.select(lo.alias("lo"), hi.alias("hi")).limit(1)
    days = span.select(day_range(F.col("lo"), F.col("hi")).alias("dt"))
    wide = presence.groupBy("dt").agg(*[F.max((F.col("feed") == f).cast("int")).alias(f"f{i}") for i, f in enumerate(feeds)])
    has = {f: F.coalesce(F.col(f"f{i}") == 1, F.lit(False)) for i, f in enumerate(feeds)}
    usable = F.lit(True)
    for f in required:
        usable = usable & has[f]
    gaps = {p: ~has[f] for p, f in fillable.items()}
    complete = usable
    for g in gaps.values():
        complete = complete & ~g
    reasons = F.array_compact(F.array(*[F.when(~has[f], F.lit(f"missing:{f}")) for f in required]))
    return days.join(wide, "dt", "left").select(
        "dt",
        usable.alias("usable"),
        complete.alias("complete"),
        *[(usable & g).alias(f"needs_{p}") for p, g in gaps.items()],
        F.array_join(reasons, ",").alias("excluded_reasons"),
    )


def calendar_route(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """excluded → vendor_fill → required, in that order."""
    x = days.join(calendar, "dt", "left")
    route = (
        F.when(F.coalesce("excluded_reasons", F.lit("")) != "", "excluded").when(F.coalesce("needs_trades", F.lit(False)), "vendor_fill").otherwise("required")
    )
    return x.select(*days.columns, route.alias("route"), F.coalesce("usable", F.lit(False)).alias("in_usable_days"))


def calendar_select(calendar: DataFrame) -> DataFrame:
    """Batchable days: complete days and trade-only fill days, minus book gaps and exclusions."""
    complete = calendar.filter("complete").select("dt")
    trade_only = calendar.filter("usable AND needs_trades AND NOT needs_book").select("dt")
    gap = calendar.filter("needs_book").select("dt")
    out = calendar.filter("excluded_reasons <> ''").select("dt")
    return complete.union(trade_only).distinct().exceptAll(gap).exceptAll(out)


def batch_assign(days: DataFrame, per_batch: int) -> DataFrame:
    """Chunk days in order; a calendar is a few thousand rows, so one ordered window is enough."""
    rn = F.row_number().over(W.orderBy("dt"))
    return days.withColumn("batch", F.floor((rn - 1) / per_batch).cast("bigint"))


def stratified_sample(days: DataFrame, spans: DataFrame, n: int, seed: int, protected: DataFrame | None = None) -> DataFrame:
    """Round-robin over date spans in a seeded hash order (a sampling operator: n is the feature)."""
    pool = days.select("dt").distinct()
    if protected is not None:
        pool = pool.join(protected.select("dt"), "dt", "left_anti")
    s = F.broadcast(spans)  # one row per split span
    x = pool.join(s, (F.col("dt") >= F.col("lo")) & (F.col("dt") <= F.col("hi")))
    x = x.groupBy("dt").agg(F.min("span").alias("span"))
    h = F.md5(F.concat_ws("|", F.col("dt").cast("string"), F.lit(str(seed))))
    depth = F.row_number().over(W.partitionBy("span").orderBy(h, "dt"))
    return x.withColumn("depth", depth.cast("bigint")).orderBy("depth", "span").limit(n)
