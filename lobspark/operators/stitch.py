"""Gap-fill planning per day, seam masks and the day-level roll-ups behind a fill manifest.

A day's grid has a fixed size (at most 86 400 samples), so day-local windows run per
``(symbol, dt)``; seams and segments are tiny tables that are range-joined to samples.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lobspark.operators.ordered import range_join
from lobspark.session import DAY_NS, NS_PER_S

KEYS = ("symbol", "dt")


@dataclass(frozen=True)
class SeamPolicy:
    """Stitch knobs; the defaults are the fixed full-rate values."""

    seam_guard_ns: int = 60 * NS_PER_S
    warmup_consecutive: int = 3
    fill_min_ns: int = 300 * NS_PER_S
    min_segment_ns: int = 3600 * NS_PER_S
    span_invalid_max: float = 0.01


PARTIAL = ("leading_partial_fill", "trailing_partial_fill", "internal_gap_fill", "mixed_partial_fill")


def plan_day_stitch(samples: DataFrame, grid_ns: int, policy: SeamPolicy = SeamPolicy(), keys: Sequence[str] = KEYS) -> DataFrame:
    """Segments ``[start_ts, end_ts)`` of each day with source, reason and the day's profile.

    ``samples``: keys, sample_ts (regular full-day grid), valid, seed_ts (null = none accepted),
    trusted. First full-day routing, then long invalid runs become fill windows, every remaining
    span requalifies after ``warmup_consecutive`` valid samples, short islands are dropped.
    """
    keys = list(keys)
    day = W.partitionBy(*keys)
    seq = day.orderBy("sample_ts")
    upto = seq.rowsBetween(W.unboundedPreceding, 0)

    x = samples.withColumns(
        {"i": F.row_number().over(seq), "day_open": F.min("sample_ts").over(day), "day_end": F.max("sample_ts").over(day) + grid_ns}
    )

    def with_runs(df: DataFrame, flag: str, name: str) -> DataFrame:
        return df.withColumn("__chg", F.coalesce((F.lag(flag).over(seq) != F.col(flag)).cast("int"), F.lit(1))).withColumn(
            name, F.sum("__chg").over(upto)
        ).drop("__chg")

    x = with_runs(x, "valid", "vrun")
    x = x.withColumn("long_fill", ~F.col("valid") & (F.count("*").over(W.partitionBy(*keys, "vrun")) * grid_ns >= policy.fill_min_ns))
    x = with_runs(x, "long_fill", "span")
    x = x.withColumn("good", F.col("valid") & F.coalesce(F.col("sample_ts") >= F.col("seed_ts"), F.lit(False)) & ~F.col("long_fill"))
    x = x.withColumn("__chg", F.coalesce(((F.lag("good").over(seq) != F.col("good")) | (F.lag("span").over(seq) != F.col("span"))).cast("int"), F.lit(1)))
    x = x.withColumn("grun", F.sum("__chg").over(upto)).drop("__chg")
    pos = F.row_number().over(W.partitionBy(*keys, "grun").orderBy("sample_ts"))
    x = x.withColumn("pos", pos)
    span = W.partitionBy(*keys, "span")
    q = F.min(F.when(F.col("good") & (F.col("pos") >= policy.warmup_consecutive), F.col("i"))).over(span)
    x = x.withColumns({"q": q, "span_end": F.max("i").over(span) + 1})
    x = x.withColumn(
        "primary",
        F.coalesce((F.col("i") >= F.col("q")) & ((F.col("span_end") - F.col("q")) * grid_ns >= policy.min_segment_ns), F.lit(False))
        & ~F.col("long_fill"),
    )
    n_p = F.sum(F.col("primary").cast("int")).over(day)
    bad = F.sum((F.col("primary") & ~F.col("valid")).cast("int")).over(day)
    route = (
        F.when(F.col("seed_ts").isNull(), "no_accepted_seed")
        .when(~F.col("trusted"), "crossed_seed_source")
        .when((n_p == 0) & (F.count("q").over(day) > 0), "trusted_span_too_short")
        .when(n_p == 0, "never_warmup_qualified")
        .when(bad / n_p > policy.span_invalid_max, "quality_over_trusted_span")
    )
    x = x.withColumn("full_day_reason", route).withColumn("primary", F.col("primary") & F.col("full_day_reason").isNull())
    x = with_runs(x, "primary", "seg")
    s = x.groupBy(*keys, "seg").agg(
        F.min("sample_ts").alias("start_ts"),
        (F.max("sample_ts") + grid_ns).alias("end_ts"),
        F.first("primary").alias("p"),
        F.first("day_open").alias("day_open"),
        F.first("day_end").alias("day_end"),
        F.first("full_day_reason").alias("full_day_reason"),
    )
    wide = (F.col("end_ts") - F.col("start_ts") >= policy.fill_min_ns) | F.col("full_day_reason").isNotNull()
    lead, trail = F.col("start_ts") == F.col("day_open"), F.col("end_ts") == F.col("day_end")
    s = s.withColumns(
        {
            "source": F.when(F.col("p"), "primary").when(wide, "fill").otherwise("excluded"),
            "reason": F.when(F.col("p"), "trusted_seeded_reconstruction")
            .when(F.col("full_day_reason").isNotNull(), F.col("full_day_reason"))
            .when(~wide, "leading_warmup_excluded")
            .when(lead, "missing_leading_segment")
            .when(trail, "missing_trailing_segment")
            .otherwise("missing_internal_segment"),
        }
    )
    return s.withColumn("fill_profile", fill_profile(keys)).select(
        *keys, "start_ts", "end_ts", "source", "reason", "fill_profile", "full_day_reason", "day_open", "day_end"
    )


def fill_profile(keys: Sequence[str] = KEYS) -> Column:
    """Profile of a day from its fill segments (a window over the day's handful of segments)."""
    day = W.partitionBy(*keys)
    fill = F.col("source") == "fill"
    lead, trail = F.col("start_ts") == F.col("day_open"), F.col("end_ts") == F.col("day_end")

    def any_of(c: Column) -> Column:
        return F.max(c.cast("int")).over(day) == 1

    l, tr, inn = any_of(fill & lead), any_of(fill & ~lead & trail), any_of(fill & ~lead & ~trail)
    kinds = l.cast("int") + tr.cast("int") + inn.cast("int")
    return (
        F.when(any_of(F.col("full_day_reason").isNotNull()), "full_day_fill")
        .when(kinds == 0, "primary_only")
        .when(kinds > 1, "mixed_partial_fill")
        .when(l, "leading_partial_fill")
        .when(tr, "trailing_partial_fill")
        .otherwise("internal_gap_fill")
    )


def full_day_plan(days: DataFrame, reason: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    from lobspark.operators.book import day_open

    return days.select(
        *keys, day_open().alias("start_ts"), (day_open() + DAY_NS).alias("end_ts"), F.lit("fill").alias("source"),
        reason.alias("reason"), F.lit("full_day_fill").alias("fill_profile"), reason.alias("full_day_reason"),
        day_open().alias("day_open"), (day_open() + DAY_NS).alias("day_end"),
    )


def seams(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Boundaries between segments of different source; the boundary belongs to the right one."""
    prev = F.lag("source").over(W.partitionBy(*keys).orderBy("start_ts"))
    return (
        segments.withColumn("prev_source", prev)
        .filter(F.col("prev_source").isNotNull() & (F.col("prev_source") != F.col("source")))
        .select(*keys, F.col("start_ts").alias("seam_ts"), "prev_source", "source")
    )


def guard_mask(samples: DataFrame, seam: DataFrame, guard_ns: int, keys: Sequence[str], *, back_ns: int = 0, ahead_ns: int = 0,
               width: int = DAY_NS) -> DataFrame:
    """Samples whose window ``[t - back, t + ahead]`` touches a guard band ``[seam - g, seam + g)``."""
    p = samples.select(*keys, "sample_ts", (F.col("sample_ts") - back_ns).alias("__lo"), (F.col("sample_ts") + ahead_ns).alias("__hi"))
    s = seam.select(*keys, (F.col("seam_ts") - guard_ns).alias("__s"), (F.col("seam_ts") + guard_ns - 1).alias("__e"))
    hit = range_join(p, s, keys, point_lo="__lo", point_hi="__hi", span_lo="__s", span_hi="__e", width=width)
    flag = hit.select(*keys, "sample_ts").distinct().withColumn("touched", F.lit(True))
    return samples.join(flag, [*keys, "sample_ts"], "left").withColumn("touched", F.coalesce("touched", F.lit(False)))


def window_crosses_seam(windows: DataFrame, seam: DataFrame, keys: Sequence[str], width: int = DAY_NS) -> DataFrame:
    """Rows (``start_ts, end_ts``) with ``start < seam <= end`` for some seam."""
    w = windows.withColumn("__lo", F.col("start_ts") + 1)
    s = seam.select(*keys, F.col("seam_ts").alias("__s"), F.col("seam_ts").alias("__e"))
    hit = range_join(w, s, keys, point_lo="__lo", point_hi="end_ts", span_lo="__s", span_hi="__e", width=width)
    return hit.select(*windows.columns).distinct()


def source_at(samples: DataFrame, segments: DataFrame, keys: Sequence[str], width: int = DAY_NS) -> DataFrame:
    s = segments.select(*keys, F.col("start_ts").alias("__s"), (F.col("end_ts") - 1).alias("__e"), "source")
    out = range_join(samples, s, keys, point_lo="sample_ts", point_hi="sample_ts", span_lo="__s", span_hi="__e", width=width)
    return out.drop("__s", "__e")


def window_sources(windows: DataFrame, segments: DataFrame, keys: Sequence[str], width: int = DAY_NS) -> DataFrame:
    """Sorted set of sources a closed window touches, plus ``uncovered`` beyond the plan's edges."""
    s = segments.select(*keys, F.col("start_ts").alias("__s"), (F.col("end_ts") - 1).alias("__e"), "source")
    edge = segments.groupBy(*keys).agg(F.min("start_ts").alias("__open"), F.max("end_ts").alias("__end"))
    hit = range_join(windows, s, keys, point_lo="start_ts", point_hi="end_ts", span_lo="__s", span_hi="__e", width=width)
    inner = hit.select(*windows.columns, "source")
    out = windows.join(edge, list(keys), "left").filter(
        F.col("__open").isNull() | (F.col("start_ts") < F.col("__open")) | (F.col("end_ts") >= F.col("__end"))
    )
    every = inner.unionByName(out.select(*windows.columns, F.lit("uncovered").alias("source")))
    return every.groupBy(*windows.columns).agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))


def check_segments(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per day: empty, overlapping or gapped segments and uncovered day edges."""
    w = W.partitionBy(*keys).orderBy("start_ts")
    x = segments.withColumn("__pe", F.lag("end_ts").over(w))
    return x.groupBy(*keys).agg(
        F.count_if(F.col("end_ts") <= F.col("start_ts")).alias("n_empty"),
        F.count_if(F.col("__pe").isNotNull() & (F.col("__pe") != F.col("start_ts"))).alias("n_not_contiguous"),
        F.count_if(~F.col("source").isin("primary", "fill", "excluded")).alias("n_unknown_source"),
        ((F.min("start_ts") != F.first("day_open")) | (F.max("end_ts") != F.first("day_end"))).alias("uncovered_edge"),
    )


# ------------------------------------------------------------------ fill manifest
def fill_block_rollup(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Class and profile counts with the sorted day lists of each group."""
    return days.groupBy(*by, "classification", "fill_profile", "full_day_reason").agg(
        F.count("*").alias("n_days"), F.min("dt").alias("first_day"), F.max("dt").alias("last_day"), F.count_if("needs_fill").alias("n_needs_fill")
    )


def batch_rollup(counts: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add up per-batch reports."""
    return counts.groupBy(*by).agg(F.count_distinct("batch").alias("n_batches"), *[F.sum(c).alias(c) for c in sums])


def fill_day_records(days: DataFrame) -> DataFrame:
    """Day × calendar × report with exclusion precedence.

    Input: dt keys, ``needs_fill, fill_profile, book_gap, trades_gap, excluded_reason``.
    """
    c = F.col
    excluded = c("excluded_reason").isNotNull()
    book = ~excluded & (F.coalesce(c("needs_fill"), F.lit(False)) | c("book_gap"))
    mapped = F.coalesce(c("needs_fill"), F.lit(False))
    return days.withColumns(
        {
            "book_needed": book,
            "book_source": F.when(book & mapped & c("book_gap"), "both").when(book & mapped, "quality_map").when(book, "calendar_gap"),
            "book_kind": F.when(book & mapped & c("fill_profile").isin(*PARTIAL), "partial").when(book, "full_day"),
            "trade_needed": ~excluded & c("trades_gap"),
            "unresolved": ~excluded & c("needs_fill").isNull() & ~c("book_gap"),
        }
    )


def fill_units(records: DataFrame, rates: DataFrame, keys: Sequence[str] = KEYS, window: tuple[Column, Column] | None = None) -> DataFrame:
    """One priced row per (day, product) that needs a fill; ``rates``: product, usd_per_gb."""
    cells = F.array(
        F.struct(F.lit("book").alias("product"), F.col("book_needed").alias("need"), F.col("book_kind").alias("kind"), F.col("book_gb").alias("gb"), F.col("book_basis").alias("gb_basis")),
        F.struct(F.lit("trades").alias("product"), F.col("trade_needed").alias("need"), F.lit("full_day").alias("kind"), F.col("trade_gb").alias("gb"), F.col("trade_basis").alias("gb_basis")),
    )
    u = records.select(*keys, F.explode(cells).alias("u")).filter("u.need").select(*keys, "u.product", "u.kind", "u.gb", "u.gb_basis")
    if window is not None:
        u = u.filter((F.col("dt") >= window[0]) & (F.col("dt") <= window[1]))
    return u.join(rates, "product").withColumn("usd", F.col("gb") * F.col("usd_per_gb")).drop("usd_per_gb")


def fill_cost_summary(units: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    def gb(product: str, basis: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("product") == product) & (F.col("gb_basis") == basis), F.col("gb"))), F.lit(0.0))

    is_book = F.col("product") == "book"
    return units.groupBy(*by).agg(
        F.count("*").alias("n_units"),
        F.count_if(is_book & (F.col("kind") == "full_day")).alias("book_full_days"),
        F.count_if(is_book & (F.col("kind") == "partial")).alias("book_partial_days"),
        F.count_if(~is_book).alias("trade_units"),
        gb("book", "measured").alias("book_gb_measured"),
        gb("book", "estimated").alias("book_gb_estimated"),
        gb("trades", "measured").alias("trades_gb_measured"),
        gb("trades", "estimated").alias("trades_gb_estimated"),
        F.sum("usd").alias("gross_usd"),
        F.coalesce(F.sum(F.when(F.col("gb_basis") == "measured", F.col("usd"))), F.lit(0.0)).alias("low_usd"),
    )


def addressability() -> Column:
    """Which fill days a better seed source could rescue."""
    c = F.col
    return (
        F.when((c("classification") == "missing") | c("book_gap"), "not_addressable_absent")
        .when(c("full_day_reason") == "crossed_seed_source", "addressable_crossed_seed_source")
        .when(c("unresolved"), "resolution_policy_days")
        .when(c("book_kind") == "partial", "not_addressable_partial_fills")
        .otherwise(F.concat(F.lit("other_"), c("classification")))
    )


def addressability_buckets(days: DataFrame, pilot: Column, by: Sequence[str] = ()) -> DataFrame:
    return days.withColumn("bucket", addressability()).groupBy(*by, "bucket").agg(
        F.count("*").alias("days"),
        F.sum("book_gb").alias("gb"),
        F.count_if(pilot).alias("pilot_days"),
        F.coalesce(F.sum(F.when(pilot, F.col("book_gb"))), F.lit(0.0)).alias("pilot_gb"),
    )


def summary_reconciliation(detail: DataFrame, declared: DataFrame, name: str = "name", value: str = "n") -> DataFrame:
    """Recomputed counts against declared ones; only mismatches are returned."""
    d = detail.select(name, F.col(value).alias("recomputed")).join(declared.select(name, F.col(value).alias("declared")), name, "full_outer")
    return d.filter(~F.col("recomputed").eqNullSafe(F.col("declared")))
