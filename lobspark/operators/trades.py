"""Trade-feed validation as venue-day aggregates.

A venue-day may be hot, so ordered metrics split it by hour (two-phase scans), quantiles are ranked
over value counts, and everything else is a plain ``groupBy`` with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.operators.book import day_open
from lobspark.operators.ordered import shift
from lobspark.operators.stats import quantiles, ranked_quantiles
from lobspark.session import DAY_NS, HOUR_NS, materialize

KEYS = ("venue", "dt")
SENTINEL_NS = 1_420_070_400_000_000_000  # 2015-01-01: older stamps mean "absent"


@dataclass(frozen=True)
class TradeThresholds:
    """Validation bars; the defaults are fixed values for full-rate venue days."""

    origin_null_max: float = 0.01
    min_rows_hard: int = 1000
    min_rows_soft: int | None = None
    dup_ts_cluster_warn: int = 50
    price_jump_warn: float = 0.10
    price_spike_warn: float = 0.50
    price_range_factor: float = 10.0
    size_max: float = 500.0
    size_hard_max: float = 5000.0
    gap_warn_s: float = 120.0
    sparse_hour_min_rows: int = 60
    max_missing_hours: int = 1
    lag_neg_max: float = 0.001
    off_day_max: float = 0.5


def null_time(c: Column) -> Column:
    return c.isNull() | (c < SENTINEL_NS)


def engine_clock(df: DataFrame) -> DataFrame:
    """Origin time, replaced by received time row by row where absent; ``unresolved`` if both are."""
    o, rcv = F.col("origin_ns"), F.col("received_ns")
    clock = F.when(~null_time(o), o).when(~null_time(rcv), rcv)
    return df.withColumns({"clock": clock, "origin_null": null_time(o), "unresolved": clock.isNull()})


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def ordered_clock(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Resolved rows in engine-clock order with the absolute return and the gap to the row before."""
    rows = engine_clock(df).filter(~F.col("unresolved"))
    rows = shift(
        rows, keys, ["clock", "pos"], {"prev_clock": F.col("clock"), "prev_price": F.col("price")}, width=HOUR_NS
    )
    p, q = F.col("price"), F.col("prev_price")
    return rows.withColumns(
        {
            "abs_ret": F.when(q != 0, F.abs((p - q) / F.when(q != 0, q))),
            "gap_s": (F.col("clock") - F.col("prev_clock")) / 1e9,
        }
    )


def dup_trade_ids(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    n = F.count("*")
    dup = n - F.count_distinct("trade_id")
    return df.groupBy(*keys).agg(dup.alias("dup_trade_id_count"), (dup / n).alias("dup_trade_id_frac"))


def dup_timestamp_clusters(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    c = engine_clock(df).filter(~F.col("unresolved")).groupBy(*keys, "clock").agg(F.count("*").alias("n"))
    return c.groupBy(*keys).agg(
        F.count_if(F.col("n") > 1).alias("dup_ts_cluster_count"), F.max("n").alias("dup_ts_max_cluster")
    )


def price_checks(
    df: DataFrame, keys: Sequence[str] = KEYS, factor: float = 10.0, clocked: DataFrame | None = None
) -> DataFrame:
    p = F.col("price")
    keys = list(keys)
    ordered = clocked if clocked is not None else ordered_clock(df, keys)
    med = quantiles(df, keys, {"price": p}, {"median": 0.5})
    ret = quantiles(ordered, keys, {"ret": F.col("abs_ret")}, {"p99": 0.99})
    top = ordered.groupBy(*keys).agg(F.max("abs_ret").alias("price_max_abs_ret"))
    m = F.col("price_median")
    band = (m > 0) & ((p < m / factor) | (p > m * factor))
    base = (
        df.join(med, keys, "left")
        .groupBy(*keys)
        .agg(
            F.min("price").alias("price_min"),
            F.max("price").alias("price_max"),
            F.first("price_median").alias("price_median"),
            F.count_if(band).alias("price_out_of_band_count"),
            F.count_if(~finite(p)).alias("price_nonfinite_count"),
        )
    )
    out = base.join(ret, keys, "left").join(top, keys, "left")
    return out.withColumns(
        {
            "price_p99_abs_ret": F.coalesce("ret_p99", F.lit(0.0)),
            "price_max_abs_ret": F.coalesce("price_max_abs_ret", F.lit(0.0)),
        }
    ).drop("ret_p99")


def size_checks(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    q = F.col("quantity")
    return df.groupBy(*keys).agg(
        F.min(q).alias("size_min"),
        F.max(q).alias("size_max"),
        (F.count_if(q == 0) / F.count("*")).alias("size_zero_frac"),
        (F.count_if((q < 0) | q.isNull() | F.isnan(q)) / F.count("*")).alias("size_neg_frac"),
    )


def notional_checks(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    n = F.col("price") * F.col("quantity")
    return df.groupBy(*keys).agg(F.sum(n).alias("notional_sum"), F.max(n).alias("notional_max_trade"))


def interarrival(df: DataFrame, keys: Sequence[str] = KEYS, clocked: DataFrame | None = None) -> DataFrame:
    ordered = clocked if clocked is not None else ordered_clock(df, keys)
    q = quantiles(ordered, keys, {"gap": F.col("gap_s")}, {"median": 0.5, "p95": 0.95, "p99": 0.99, "max": 1.0})
    every = df.select(*keys).distinct().join(q, list(keys), "left")
    names = {"median": "interarrival_median_s", "p95": "interarrival_p95_s", "p99": "interarrival_p99_s", "max": "interarrival_max_s"}
    return every.select(*keys, *[F.coalesce(f"gap_{p}", F.lit(0.0)).alias(n) for p, n in names.items()])


def hour_coverage(df: DataFrame, keys: Sequence[str] = KEYS, sparse_min_rows: int = 60) -> DataFrame:
    """UTC hours of the declared day without rows, and hours with fewer than the minimum."""
    rows = engine_clock(df).filter(~F.col("unresolved"))
    off = F.col("clock") - day_open()
    inside = (off >= 0) & (off < DAY_NS)
    hours = (
        rows.filter(inside)
        .groupBy(*keys, F.expr(f"(clock - unix_micros(cast(dt as timestamp)) * 1000) div {HOUR_NS}L").alias("h"))
        .agg(F.count("*").alias("n"))
        .groupBy(*keys)
        .agg(
            F.collect_set("h").alias("seen"),
            F.collect_set(F.when(F.col("n") < sparse_min_rows, F.col("h"))).alias("thin"),
        )
    )
    every = df.select(*keys).distinct().join(hours, list(keys), "left")
    none = F.array().cast("array<bigint>")
    missing = F.array_except(F.sequence(F.lit(0), F.lit(23)).cast("array<bigint>"), F.coalesce("seen", none))
    return every.select(
        *keys,
        F.array_sort(missing).alias("missing_hours"),
        F.array_sort(F.coalesce("thin", none)).alias("sparse_hours"),
    )


def lag_metrics(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    both = df.filter(~null_time(F.col("origin_ns")) & ~null_time(F.col("received_ns")))
    both = both.withColumn("lag_ms", (F.col("received_ns") - F.col("origin_ns")) / 1e6)
    q = quantiles(both, keys, {"lag": F.col("lag_ms")}, {"median": 0.5, "p95": 0.95})
    neg = both.groupBy(*keys).agg(F.avg((F.col("lag_ms") < 0).cast("double")).alias("recv_origin_lag_neg_frac"))
    out = df.select(*keys).distinct().join(q, list(keys), "left").join(neg, list(keys), "left")
    return out.select(
        *keys,
        F.col("lag_median").alias("recv_origin_lag_median_ms"),
        F.col("lag_p95").alias("recv_origin_lag_p95_ms"),
        F.coalesce("recv_origin_lag_neg_frac", F.lit(0.0)).alias("recv_origin_lag_neg_frac"),
    )


def off_day_fraction(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    off = F.col("clock") - day_open()
    return (
        engine_clock(df)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.avg(F.when(~F.col("unresolved"), ((off < 0) | (off >= DAY_NS)).cast("double"))), F.lit(0.0)).alias(
                "off_day_frac"
            )
        )
    )


def side_values(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys, "side").agg(F.count("*").alias("n"))


def clock_flags(df: DataFrame, keys: Sequence[str] = KEYS, pos_width: int = 1_000_000) -> DataFrame:
    """Row count, time-null fractions, unresolved rows and whether the file came in origin order."""
    rows = shift(engine_clock(df), keys, ["pos"], {"prev_origin": F.col("origin_ns")}, width=pos_width)
    broken = F.col("origin_ns").isNull() | F.coalesce(F.col("origin_ns") < F.col("prev_origin"), F.lit(False))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("row_count"),
        F.avg(F.col("origin_null").cast("double")).alias("origin_null_frac"),
        F.avg(null_time(F.col("received_ns")).cast("double")).alias("received_null_frac"),
        F.count_if("unresolved").alias("unresolved_count"),
        (~F.bool_or(broken)).alias("was_presorted"),
        F.min("clock").alias("first_ns"),
        F.max("clock").alias("last_ns"),
        F.count_if(~F.coalesce(F.col("side").isin("buy", "sell"), F.lit(False))).alias("side_unexpected"),
    )


#: Quantiles of a trade day by value.
DAY_QUANTILES = {
    "price": {"median": 0.5},
    "ret": {"p99": 0.99},
    "gap": {"median": 0.5, "p95": 0.95, "p99": 0.99, "max": 1.0},
    "lag": {"median": 0.5, "p95": 0.95},
}


def trade_day_metrics(
    df: DataFrame, thresholds: TradeThresholds = TradeThresholds(), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Every metric of a venue-day in one row; equal to the single checks, in three aggregations over the rows.

    Rows get the row before them once. One plain aggregation gives sums and extremes; one long frame counts every value of
    every metric (prices, returns, gaps, lags, instants, ids, hours), which answers repeats, hours and, by one ranking,
    all quantiles.
    """
    keys = list(keys)
    rest = engine_clock(df).filter("unresolved")
    rows = ordered_clock(df, keys).unionByName(rest, allowMissingColumns=True)
    rows = materialize(rows.select(*keys, "pos", "clock", "unresolved", "origin_null", "origin_ns", "received_ns", "price", "quantity", "side", "trade_id", "abs_ret", "gap_s"))
    p, q, off = F.col("price"), F.col("quantity"), F.col("clock") - day_open()
    inside = (off >= 0) & (off < DAY_NS)
    both_times = ~null_time(F.col("origin_ns")) & ~null_time(F.col("received_ns"))
    lag = F.when(both_times, (F.col("received_ns") - F.col("origin_ns")) / 1e6)

    flags = shift(rows, keys, ["pos"], {"prev_origin": F.col("origin_ns")}, width=1_000_000)
    broken = F.col("origin_ns").isNull() | F.coalesce(F.col("origin_ns") < F.col("prev_origin"), F.lit(False))
    n = F.count("*")
    base = flags.groupBy(*keys).agg(
        n.alias("row_count"),
        F.avg(F.col("origin_null").cast("double")).alias("origin_null_frac"),
        F.avg(null_time(F.col("received_ns")).cast("double")).alias("received_null_frac"),
        F.count_if("unresolved").alias("unresolved_count"),
        (~F.bool_or(broken)).alias("was_presorted"),
        F.min("clock").alias("first_ns"),
        F.max("clock").alias("last_ns"),
        F.count_if(~F.coalesce(F.col("side").isin("buy", "sell"), F.lit(False))).alias("side_unexpected"),
        F.min(p).alias("price_min"),
        F.max(p).alias("price_max"),
        F.count_if(~finite(p)).alias("price_nonfinite_count"),
        F.coalesce(F.max("abs_ret"), F.lit(0.0)).alias("price_max_abs_ret"),
        F.min(q).alias("size_min"),
        F.max(q).alias("size_max"),
        (F.count_if(q == 0) / n).alias("size_zero_frac"),
        (F.count_if((q < 0) | q.isNull() | F.isnan(q)) / n).alias("size_neg_frac"),
        F.sum(p * q).alias("notional_sum"),
        F.max(p * q).alias("notional_max_trade"),
        F.coalesce(F.avg((lag < 0).cast("double")), F.lit(0.0)).alias("recv_origin_lag_neg_frac"),
        F.coalesce(F.avg(F.when(~F.col("unresolved"), (~inside).cast("double"))), F.lit(0.0)).alias("off_day_frac"),
    )

    def case(name: str, value: Column | None = None, number: Column | None = None, text: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(name).alias("__m"), (none if value is None else value).cast("double").alias("__v"),
            (none if number is None else number).cast("bigint").alias("b"), (none if text is None else text).cast("string").alias("t"),
        )

    cases = [case("price", p), case("ret", F.col("abs_ret")), case("gap", F.col("gap_s")), case("lag", lag)]
    cases += [case("ts", number=F.col("clock")), case("id", text=F.col("trade_id")), case("hour", number=F.when(inside, F.floor(off / HOUR_NS)))]
    long = rows.select(*keys, F.inline(F.array(*cases))).where("__v is not null or b is not null or t is not null")
    counts = materialize(long.groupBy(*keys, "__m", "__v", "b", "t").agg(F.count("*").alias("__n")))
    of = lambda name: F.col("__m") == name
    none = F.array().cast("array<bigint>")
    repeats = counts.where("__v is null").groupBy(*keys).agg(
        F.count_if(of("ts") & (F.col("__n") > 1)).alias("dup_ts_cluster_count"),
        F.coalesce(F.max(F.when(of("ts"), F.col("__n"))), F.lit(0)).alias("dup_ts_max_cluster"),
        F.count_if(of("id")).alias("__ids"),
        F.collect_set(F.when(of("hour"), F.col("b"))).alias("__seen"),
        F.collect_set(F.when(of("hour") & (F.col("__n") < thresholds.sparse_hour_min_rows), F.col("b"))).alias("__thin"),
    )
    values = counts.where("__v is not null and not isnan(__v)").select(*keys, "__m", "__v", "__n")
    ranked = ranked_quantiles(values, keys, DAY_QUANTILES)
    m, factor = F.col("price_median"), thresholds.price_range_factor
    band = (m > 0) & ((F.col("__v") < m / factor) | (F.col("__v") > m * factor))
    outside = counts.where("__m = 'price'").join(ranked.select(*keys, "price_median"), keys).groupBy(*keys).agg(F.coalesce(F.sum(F.when(band, F.col("__n"))), F.lit(0)).alias("price_out_of_band_count"))
    out = base.join(repeats, keys, "left").join(ranked, keys, "left").join(outside, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    missing = F.array_except(F.sequence(F.lit(0), F.lit(23)).cast("array<bigint>"), F.coalesce("__seen", none))
    dup = F.col("row_count") - F.coalesce("__ids", F.lit(0))
    return out.withColumns(
        {
            "dup_ts_cluster_count": F.coalesce("dup_ts_cluster_count", F.lit(0)),
            "dup_ts_max_cluster": F.coalesce("dup_ts_max_cluster", F.lit(0)),
            "dup_trade_id_count": dup,
            "dup_trade_id_frac": dup / F.col("row_count"),
            "price_out_of_band_count": F.coalesce("price_out_of_band_count", F.lit(0)),
            "price_p99_abs_ret": zero("ret_p99"),
            **{f"interarrival_{q}_s": zero(f"gap_{q}") for q in DAY_QUANTILES["gap"]},
            "missing_hours": F.array_sort(missing),
            "sparse_hours": F.array_sort(F.coalesce("__thin", none)),
            "recv_origin_lag_median_ms": F.col("lag_median"),
            "recv_origin_lag_p95_ms": F.col("lag_p95"),
        }
    ).drop("__ids", "__seen", "__thin", "ret_p99", "lag_median", "lag_p95", *[f"gap_{q}" for q in DAY_QUANTILES["gap"]])


def classify_trade_day(m: DataFrame, t: TradeThresholds = TradeThresholds()) -> DataFrame:
    """``status`` and ordered ``reasons`` per venue-day; a ``route`` column wins over the metrics."""
    c = F.col

    def codes(*rules: tuple[Column, str]) -> Column:
        return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in rules]))

    spike = (c("price_max_abs_ret") > t.price_spike_warn) | (c("price_out_of_band_count") > 0)
    hard = c("size_max") > t.size_hard_max
    nonpos = c("notional_sum").isNull() | (c("notional_sum") <= 0)
    n_missing = F.size("missing_hours")
    soft = F.lit(False) if t.min_rows_soft is None else (
        (c("row_count") >= t.min_rows_hard) & (c("row_count") < t.min_rows_soft)
    )
    fails = codes(
        (c("unresolved_count") > 0, "nonmonotonic_after_sort"),
        (c("unresolved_count") > 0, "received_time_fallback_unavailable"),
        (
            (c("unresolved_count") == 0) & (c("origin_null_frac") > t.origin_null_max),
            "origin_time_null_fraction_high",
        ),
        (c("row_count") < t.min_rows_hard, "row_count_implausibly_low"),
        (c("off_day_frac") > t.off_day_max, "wrong_day_partition"),
        ((c("price_nonfinite_count") > 0) | c("price_min").isNull() | (c("price_min") <= 0), "price_out_of_range"),
        (spike, "price_spike"),
        ((c("size_zero_frac") > 0) | (c("size_neg_frac") > 0), "size_nonpositive"),
        (hard, "size_out_of_band"),
        (nonpos, "notional_nonpositive"),
        (c("recv_origin_lag_neg_frac") > t.lag_neg_max, "lag_negative"),
        (n_missing > t.max_missing_hours, "missing_hours_excess"),
    )
    warns = codes(
        (
            (c("unresolved_count") == 0) & (c("origin_null_frac") > 0) & (c("origin_null_frac") <= t.origin_null_max),
            "received_time_fallback_used",
        ),
        (soft, "row_count_low"),
        (~spike & (c("price_p99_abs_ret") > t.price_jump_warn), "price_jump_excess"),
        (~hard & (c("size_max") > t.size_max), "size_out_of_range"),
        (c("dup_ts_max_cluster") > t.dup_ts_cluster_warn, "duplicate_timestamp_cluster"),
        (c("dup_trade_id_count") > 0, "duplicate_trade_id"),
        (c("interarrival_max_s") > t.gap_warn_s, "interarrival_gap_excess"),
        (c("side_unexpected") > 0, "side_value_unexpected"),
        (F.size("sparse_hours") > 0, "sparse_hour"),
        ((n_missing > 0) & (n_missing <= t.max_missing_hours), "missing_hour"),
    )
    routed = c("route") if "route" in m.columns else F.lit("required")
    status = (
        F.when(routed == "excluded", "excluded")
        .when(routed == "vendor_fill", "vendor_fill")
        .when(F.size("__fails") > 0, "fail")
        .when(F.size("__warns") > 0, "warn")
        .otherwise("pass")
    )
    reasons = (
        F.when(routed == "excluded", F.array(F.lit("calendar_excluded_day")))
        .when(routed == "vendor_fill", F.array(F.lit("vendor_fill_day")))
        .when((F.size("__fails") == 0) & (F.size("__warns") == 0), F.array(F.lit("ok")))
        .otherwise(F.concat("__fails", "__warns"))
    )
    return (
        m.withColumns({"__fails": fails, "__warns": warns})
        .withColumns({"status": status, "reasons": reasons})
        .drop("__fails", "__warns")
    )


def validation_report(records: DataFrame) -> DataFrame:
    """Per-venue status counts with the gate the bar builder reads.

    ``records``: venue, dt, vendor_source, status. A fill day is cleared by a passing or warning
    record of the second vendor for the same venue-day; anything failing blocks.
    """
    cleared = (
        records.filter((F.col("vendor_source") == "secondary") & F.col("status").isin("pass", "warn"))
        .select("venue", "dt")
        .distinct()
        .withColumn("cleared", F.lit(True))
    )
    r = records.join(cleared, ["venue", "dt"], "left")
    deferred = (F.col("status") == "vendor_fill") & F.col("cleared").isNull()
    states = ("pass", "warn", "fail", "excluded", "vendor_fill")
    out = r.groupBy("venue").agg(
        F.count_distinct("dt").alias("n_days"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in states],
        F.count_if(deferred).alias("n_fill_deferred"),
    )
    return out.withColumns(
        {
            "required_pass": F.col("n_fail") == 0,
            "bars_ready": (F.col("n_fail") == 0) & (F.col("n_fill_deferred") == 0),
        }
    )
