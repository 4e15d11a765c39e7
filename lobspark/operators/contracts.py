"""Contract checks as violation tables, and content fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.operators.ordered import shift
from lobspark.session import HOUR_NS
from lobspark.sources.scans import bad_number, violations

RESERVED = ("y_fwd_bps", "label", "t_event", "t_barrier", "t_feature_start", "t_available", "cost_bps", "half_spread_bps", "uniqueness", "regime", "horizon")
NUMERIC = ("y_fwd_bps", "cost_bps", "half_spread_bps", "uniqueness")
TIMING = ("t_event", "t_barrier", "t_feature_start", "t_available")


def require_columns(df: DataFrame, features: Sequence[str], reserved: Sequence[str] = RESERVED) -> None:
    """Schema part of the contract: fails before any job runs."""
    dup = sorted({c for c in df.columns if df.columns.count(c) > 1} | {c for c in features if list(features).count(c) > 1})
    missing = [c for c in [*features, *reserved] if c not in df.columns]
    both = sorted(set(features) & set(reserved))
    types = dict(df.dtypes)
    odd = [c for c in TIMING if c in types and types[c] not in ("bigint", "int")]
    if dup or missing or both or odd:
        raise ValueError(f"matrix contract: duplicate {dup}, missing {missing}, reserved as feature {both}, non-integer times {odd}")


def _any(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def _nonfinite(c: str) -> Column:
    v = F.col(c)
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def _hit(c: Column) -> Column:
    """A rule on null inputs is not itself a violation; nulls have their own rule."""
    return F.coalesce(c, F.lit(False))


def matrix_rules(features: Sequence[str]) -> dict[str, Column]:
    c = F.col
    return {
        "null_or_nonfinite": _any([_nonfinite(x) for x in [*features, *NUMERIC]]),
        "null_timing": _any([c(x).isNull() for x in TIMING]),
        "barrier_before_event": _hit(c("t_barrier") < c("t_event")),
        "feature_after_event": _hit(c("t_feature_start") > c("t_event")),
        "available_before_event": _hit(c("t_available") < c("t_event")),
        "not_synchronous": _hit(c("t_available") != c("t_event")),
        "label_domain": _hit(~c("label").isin(-1, 0, 1)),
        "uniqueness_domain": _hit(~((c("uniqueness") > 0) & (c("uniqueness") <= 1))),
        "negative_cost": _hit(c("cost_bps") < 0),
        "negative_half_spread": _hit(c("half_spread_bps") < 0),
    }


def check_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    require_columns(df, features)
    return violations(df, matrix_rules(features))


def check_frame(df: DataFrame, horizons: Mapping[str, int], *, max_lookback_ns: int, availability_lag_ns: int = 0,
                known: Sequence[str] | None = None) -> DataFrame:
    """Frame against its manifest: look-back, declared horizons, barrier and availability limits."""
    if known is not None:
        unknown = [c for c in df.columns if c not in known]
        if unknown:
            raise ValueError(f"columns not declared in the manifest: {unknown}")
    c = F.col
    h = F.lit(None).cast("bigint")
    for tag, n in horizons.items():
        h = F.when(c("horizon") == tag, F.lit(n)).otherwise(h)
    return violations(
        df,
        {
            "lookback_over_declared": _hit(c("t_event") - c("t_feature_start") > max_lookback_ns),
            "undeclared_horizon": h.isNull(),
            "barrier_past_horizon": _hit(c("t_barrier") - c("t_event") > h),
            "available_before_event": _hit(c("t_available") < c("t_event")),
            "available_after_lag": _hit(c("t_available") > c("t_event") + availability_lag_ns),
            "barrier_before_event": _hit(c("t_barrier") < c("t_event")),
            "feature_after_event": _hit(c("t_feature_start") > c("t_event")),
        },
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def matched_rows(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows only one side has (as multisets), counted per side."""
    x, y = a.select(*cols), b.select(*cols)
    left = x.exceptAll(y).agg(F.lit("only_left").alias("side"), F.count("*").alias("n"))
    return left.unionByName(y.exceptAll(x).agg(F.lit("only_right").alias("side"), F.count("*").alias("n")))


def row_hash(cols: Sequence[str]) -> Column:
    """md5 of the canonical ``|``-joined text of a row."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]))


def dataset_fingerprint(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Content hash independent of file layout and row order: sums and xors of two 64-bit row hashes."""
    canon = sorted(cols)
    a = F.xxhash64(*[F.col(c) for c in canon])
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in canon])
    b = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.bit_xor(a).alias("xor_hash"), F.sum(F.pmod(a, F.lit(1 << 31))).alias("sum_hash"), F.sum(b).alias("sum_md5")
    )


def bar_rules() -> dict[str, Column]:
    c = F.col
    close = F.coalesce("cap_fire", "last_origin")
    return {
        "bad_threshold": bad_number(c("threshold")),
        "close_before_start": _hit(close < c("interval_start")),
        "received_after_event": _hit(c("max_received") > c("t_event")),
        "unknown_reason": ~c("close_reason").isin("threshold", "time_cap", "day_end"),
        "threshold_not_reached": _hit((c("close_reason") == "threshold") & (c("notional") < c("threshold"))),
        "cap_without_fire": (c("close_reason") == "time_cap") & c("cap_fire").isNull(),
    }


def check_bars(bars: DataFrame) -> DataFrame:
    return violations(bars, bar_rules())


def read_rules(k: int) -> dict[str, Column]:
    """Surviving reads: finite positive touch, monotone ladders, uncrossed, not from the future."""
    c = F.col
    order = []
    for i in range(k - 1):
        order.append(_hit(c(f"bid_{i}_price") <= c(f"bid_{i + 1}_price")))
        order.append(_hit(c(f"ask_{i}_price") >= c(f"ask_{i + 1}_price")))
    rules = {
        "bad_touch": _any([bad_number(c(x)) for x in ("bid_0_price", "ask_0_price", "bid_0_size", "ask_0_size", "mid", "microprice")]),
        "crossed_or_locked": _hit(c("bid_0_price") >= c("ask_0_price")),
        "ladder_not_monotone": _any(order) if order else F.lit(False),
        "read_after_event": _hit(c("target_read_ts") > c("t_event")),
        "mid_mismatch": _hit(c("mid") != (c("bid_0_price") + c("ask_0_price")) / 2.0),
    }
    return {name: c("reason").isNull() & rule for name, rule in rules.items()}


def check_reads(reads: DataFrame, k: int) -> DataFrame:
    return violations(reads, read_rules(k))


def span_rules() -> dict[str, Column]:
    c = F.col
    return {
        "empty_span": _hit(c("t_barrier") <= c("t_event")),
        "negative_lookback": _hit(c("t_feature_start") > c("t_event")),
        "null_time": c("t_event").isNull() | c("t_barrier").isNull() | c("t_feature_start").isNull(),
    }


def check_spans(rows: DataFrame) -> DataFrame:
    return violations(rows, span_rules())


def path_rules(ts: str = "ts") -> dict[str, Column]:
    """For a path with its previous time in ``__p`` (``with_previous``)."""
    return {"bad_mid": bad_number(F.col("mid")), "not_increasing": _hit(F.col(ts) <= F.col("__p"))}


def with_previous(path: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return shift(path, keys, [ts], {"__p": F.col(ts)}, width=24 * HOUR_NS)


def check_path(path: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return violations(with_previous(path, keys, ts), path_rules(ts))


def cost_rules() -> dict[str, Column]:
    return {f"bad_{x}": bad_number(F.col(x), positive=False) for x in ("half_spread_bps", "latency_drift_bps", "slippage_bps", "cost_bps")}


def check_costs(rows: DataFrame) -> DataFrame:
    return violations(rows, cost_rules())


def hour_partition_checks(rows: DataFrame, keys: Sequence[str], hour_ns: str, ts: str) -> DataFrame:
    """Hourly partitions: present hours, missing hours between them, share of rows inside their hour."""
    keys = list(keys)
    inside = (F.col(ts) >= F.col(hour_ns)) & (F.col(ts) < F.col(hour_ns) + HOUR_NS)
    per = rows.groupBy(*keys, hour_ns).agg(F.count("*").alias("n"), F.count_if(inside).alias("n_in"))
    per = shift(per, keys, [hour_ns], {"__p": F.col(hour_ns)}, width=24 * HOUR_NS)
    step = (F.col(hour_ns) - F.col("__p")) / HOUR_NS
    return per.groupBy(*keys).agg(
        F.count("*").alias("n_hours"),
        F.coalesce(F.sum(F.when(step > 1, step - 1)), F.lit(0.0)).cast("bigint").alias("n_missing_hours"),
        (F.sum("n_in") / F.sum("n")).alias("fraction_inside"),
        F.min(F.col("n_in") / F.col("n")).alias("worst_hour_fraction"),
    )
