"""Agreement of two books sampled on the same grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.operators.stats import abs_stats, quantiles

SPIKE_BARS = (1.0, 5.0, 10.0, 50.0, 100.0, 200.0)  # price units


def align(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Inner join on the grid; columns become ``a_*`` and ``b_*``."""
    on = [*keys, "sample_ts"]

    def tag(df: DataFrame, p: str) -> DataFrame:
        return df.select(*on, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in on])

    return tag(a, "a").join(tag(b, "b"), on)


def has_top(p: str) -> Column:
    return F.col(f"{p}_bid_0_price").isNotNull() & F.col(f"{p}_ask_0_price").isNotNull()


def is_crossed(p: str) -> Column:
    return F.coalesce(F.col(f"{p}_bid_0_price") >= F.col(f"{p}_ask_0_price"), F.lit(False))


def compare_topk(pair: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Missing and crossed rates of both books and the signed mean / correlation of their mids."""
    both = has_top("a") & has_top("b")
    d = F.col("a_mid") - F.col("b_mid")

    def frac(c: Column) -> Column:
        return F.avg(c.cast("double"))

    return pair.groupBy(*keys).agg(
        F.count("*").alias("n_grid"),
        F.count_if(both).alias("both_present"),
        frac(~has_top("a")).alias("a_missing_fraction"),
        frac(~has_top("b")).alias("b_missing_fraction"),
        frac(~both).alias("either_missing_fraction"),
        frac(is_crossed("a")).alias("a_crossed_rate"),
        frac(is_crossed("b")).alias("b_crossed_rate"),
        F.avg(F.when(both, d)).alias("signed_mean"),
        F.corr(F.when(both, F.col("a_mid")), F.when(both, F.col("b_mid"))).alias("mid_corr"),
    )


def diff_stats(pair: DataFrame, keys: Sequence[str] = ("symbol",), k: int = 1) -> DataFrame:
    """Distribution of absolute differences: mid, mid in bps, touch, and price/size of each level."""
    both = has_top("a") & has_top("b")
    d = F.abs(F.col("a_mid") - F.col("b_mid"))
    ref = (F.col("a_mid") + F.col("b_mid")) / 2.0
    vals: dict[str, Column] = {
        "mid": F.when(both, d),
        "mid_bps": F.when(both & (ref != 0), d / F.when(ref != 0, ref) * 1e4),
        "best_bid": F.when(both, F.abs(F.col("a_bid_0_price") - F.col("b_bid_0_price"))),
        "best_ask": F.when(both, F.abs(F.col("a_ask_0_price") - F.col("b_ask_0_price"))),
    }
    for i in range(k):
        for s in ("bid", "ask"):
            for f in ("price", "size"):
                vals[f"{s}_{i}_{f}"] = F.abs(F.col(f"a_{s}_{i}_{f}") - F.col(f"b_{s}_{i}_{f}"))
    return abs_stats(pair, keys, vals)


def level_coverage(pair: DataFrame, k: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per level and side: samples where both, only a, or only b have the level."""
    cells = []
    for i in range(k):
        for s in ("bid", "ask"):
            cells.append(
                F.struct(
                    F.lit(s).alias("side"),
                    F.lit(i).cast("bigint").alias("level"),
                    F.col(f"a_{s}_{i}_price").isNotNull().alias("a"),
                    F.col(f"b_{s}_{i}_price").isNotNull().alias("b"),
                )
            )
    x = pair.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*")
    a, b = F.col("a"), F.col("b")
    return x.groupBy(*keys, "side", "level").agg(
        F.count_if(a & b).alias("both_present"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b")
    )


def spike_distribution(pair: DataFrame, keys: Sequence[str] = ("symbol",), bars: Sequence[float] = SPIKE_BARS) -> DataFrame:
    d = F.abs(F.col("a_mid") - F.col("b_mid"))
    base = pair.filter(d.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.count_if(d > b).alias(f"c{i}") for i, b in enumerate(bars)]
    )
    cells = [F.struct(F.lit(float(b)).alias("bar"), F.col(f"c{i}").alias("n_over")) for i, b in enumerate(bars)]
    return base.select(*keys, "n", F.explode(F.array(*cells)).alias("x")).select(
        *keys, "x.bar", "x.n_over", (F.col("x.n_over") / F.col("n")).alias("fraction")
    )


def top_spikes(pair: DataFrame, n: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The ``n`` largest mid differences overall (a report: the limit is the feature)."""
    d = F.round(F.abs(F.col("a_mid") - F.col("b_mid")), 9)
    return (
        pair.withColumn("abs_dmid", d)
        .filter(F.col("abs_dmid").isNotNull())
        .orderBy(F.desc("abs_dmid"), *keys, "sample_ts")
        .limit(n)
        .select(*keys, "sample_ts", "a_mid", "b_mid", "abs_dmid")
    )


def with_forward(df: DataFrame, mids: Mapping[str, str], step_ns: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Forward moves over exactly ``step_ns`` on the regular grid (null where either end is null)."""
    fwd = df.select(*keys, (F.col("sample_ts") - step_ns).alias("sample_ts"), *[F.col(m).alias(f"__{n}") for n, m in mids.items()])
    out = df.join(fwd, [*keys, "sample_ts"], "left")
    return out.withColumns({n: F.col(f"__{n}") - F.col(m) for n, m in mids.items()}).drop(*[f"__{n}" for n in mids])


def signed_label(fwd: Column, mid: Column, band_bps: float) -> Column:
    """Sign of the forward move, 0 inside the band, null without a forward point."""
    return F.when(fwd.isNull(), None).when(F.abs(fwd) > band_bps * 1e-4 * F.abs(mid), F.signum(fwd)).otherwise(0.0).cast("bigint")


def label_agreement(pair: DataFrame, steps: Mapping[str, int], keys: Sequence[str] = ("symbol",), band_bps: float = 0.0) -> DataFrame:
    """Directional agreement of both mids per horizon; mask excluded samples to null first, never drop them."""
    parts = None
    slim = pair.select(*keys, "sample_ts", "a_mid", "b_mid")
    for tag, step in steps.items():
        x = with_forward(slim, {"fa": "a_mid", "fb": "b_mid"}, step, keys)
        x = x.withColumns({"la": signed_label(F.col("fa"), F.col("a_mid"), band_bps), "lb": signed_label(F.col("fb"), F.col("b_mid"), band_bps)})
        x = x.filter(F.col("la").isNotNull() & F.col("lb").isNotNull())
        a, b = F.col("la"), F.col("lb")
        g = x.groupBy(*keys).agg(
            F.lit(tag).alias("horizon"),
            F.count("*").alias("n"),
            F.avg((a == b).cast("double")).alias("agreement"),
            F.count_if((a == 1) & (b == 1)).alias("both_up"),
            F.count_if((a == -1) & (b == -1)).alias("both_down"),
            F.count_if((a == 0) & (b == 0)).alias("both_flat"),
            F.count_if(a != b).alias("disagree"),
            F.when((F.count("*") > 2) & (F.stddev("fa") > 0) & (F.stddev("fb") > 0), F.corr("fa", "fb")).alias("fwd_return_corr"),
        )
        parts = g if parts is None else parts.unionByName(g)
    return parts


def compare_ticks(pair: DataFrame, k: int, scale: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Touch agreement in integer ticks over jointly valid samples and shared levels of the top-K."""
    ok = has_top("a") & has_top("b") & ~is_crossed("a") & ~is_crossed("b")

    def tick(c: str) -> Column:
        return F.rint(F.col(c) * scale)

    def ladder(p: str, s: str) -> Column:
        return F.array_compact(F.array(*[tick(f"{p}_{s}_{i}_price") for i in range(k)]))

    j = pair.filter(ok).withColumns(
        {
            "db": F.abs(tick("a_bid_0_price") - tick("b_bid_0_price")),
            "da": F.abs(tick("a_ask_0_price") - tick("b_ask_0_price")),
            "dm": F.abs(
                (tick("a_bid_0_price") + tick("a_ask_0_price")) / 2 - (tick("b_bid_0_price") + tick("b_ask_0_price")) / 2
            ),
            "sb": F.size(F.array_intersect(ladder("a", "bid"), ladder("b", "bid"))),
            "sa": F.size(F.array_intersect(ladder("a", "ask"), ladder("b", "ask"))),
        }
    )
    base = pair.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.count_if(ok).alias("n_joint_valid"), F.avg(ok.cast("double")).alias("joint_valid_fraction")
    )
    touch = j.groupBy(*keys).agg(
        F.avg(((F.col("db") == 0) & (F.col("da") == 0)).cast("double")).alias("touch_exact"),
        F.avg(((F.col("db") <= 1) & (F.col("da") <= 1)).cast("double")).alias("touch_within_1"),
        F.avg("sb").alias("shared_bid_levels"),
        F.avg("sa").alias("shared_ask_levels"),
    )
    q = quantiles(j, keys, {"bid": F.col("db"), "ask": F.col("da"), "mid": F.col("dm")}, {"p50": 0.5, "p95": 0.95, "p99": 0.99, "max": 1.0})
    return base.join(touch, list(keys), "left").join(q, list(keys), "left")


def evaluate_thresholds(metrics: DataFrame, bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Metrics (long: ``metric, value``) against bars (``metric, op, bound``); a missing metric fails."""
    every = metrics.select(*keys).distinct().crossJoin(F.broadcast(bars))  # bars: one row per criterion, fixed size
    v, b = F.col("value"), F.col("bound")
    ok = F.when(v.isNull(), False).when(F.col("op") == ">=", v >= b).when(F.col("op") == "<=", v <= b).otherwise(v > b)
    return every.join(metrics, [*keys, "metric"], "left").withColumn("ok", ok)


def frame_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Unit-wise difference of two result sets: missing in one, or the list of differing columns."""
    left = a.select(*keys, F.struct(*cols).alias("__a"))
    right = b.select(*keys, F.struct(*cols).alias("__b"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), F.lit(c)) for c in cols]))
    out = left.join(right, list(keys), "full_outer")
    status = (
        F.when(F.col("__a").isNull() | F.col("__b").isNull(), "missing_in_one_run")
        .when(F.size(differ) > 0, F.concat(F.lit("keys_differ:"), F.array_join(differ, ",")))
        .otherwise("equal")
    )
    return out.select(*keys, status.alias("diff"))


def mask_mids(pair: DataFrame, drop: Column) -> DataFrame:
    """Null both mids where ``drop`` holds, keeping the regular grid for forward labels."""
    return pair.withColumns({c: F.when(~F.coalesce(drop, F.lit(False)), F.col(c)) for c in ("a_mid", "b_mid")})
