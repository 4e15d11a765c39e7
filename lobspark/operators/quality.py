"""Book quality on a sample grid: rates, runs, warm-up, frozen and silent stretches, seed checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.operators.ordered import islands, shift
from lobspark.session import DAY_NS

BID, ASK = "bid_0_price", "ask_0_price"


def present() -> Column:
    return F.col(BID).isNotNull() & F.col(ASK).isNotNull()


def crossed() -> Column:
    return F.coalesce(F.col(BID) >= F.col(ASK), F.lit(False))


def valid(min_levels: int = 1) -> Column:
    """Both tops present, uncrossed and at least ``min_levels`` levels a side."""
    deep = (F.col("bid_depth") >= min_levels) & (F.col("ask_depth") >= min_levels)
    return F.coalesce(present() & ~crossed() & deep, F.lit(False))


def frame_quality(frame: DataFrame, keys: Sequence[str], k: int = 1) -> DataFrame:
    """Sample counts with crossed, missing and thin (fewer than ``k`` levels) rates."""
    n = F.count("*")
    thin = present() & ~crossed() & (F.least("bid_depth", "ask_depth") < k)
    c, m, th = F.count_if(crossed()), F.count_if(~present()), F.count_if(thin)
    return frame.groupBy(*keys).agg(
        n.alias("n_samples"),
        c.alias("crossed_samples"),
        (c / n).alias("crossed_rate"),
        m.alias("missing_book_samples"),
        (m / n).alias("missing_book_fraction"),
        th.alias("thin_depth_samples"),
        (th / n).alias("thin_depth_fraction"),
    )


def crossed_duration(quotes: DataFrame, keys: Sequence[str], end_ns: Column, start_ns: Column | None = None,
                     width: int = DAY_NS) -> DataFrame:
    """Nanoseconds spent crossed in the event-by-event book, closed at ``end_ns``.

    With ``start_ns`` (a seed time) only states from then on count.
    """
    q = quotes.filter(F.col("ts") >= start_ns) if start_ns is not None else quotes
    nxt = shift(q, keys, ["ts", "seq"], {"next_ts": F.col("ts")}, width=width, lead=True)
    is_crossed = F.coalesce(F.col("best_bid") >= F.col("best_ask"), F.lit(False))
    stop = F.coalesce("next_ts", F.greatest(end_ns, F.col("ts")))
    return nxt.groupBy(*keys).agg(
        F.sum(F.when(is_crossed, stop - F.col("ts")).otherwise(0)).cast("bigint").alias("crossed_duration_ns")
    )


def runs(frame: DataFrame, keys: Sequence[str], flag: Column, grid_ns: int, ts: str = "sample_ts") -> DataFrame:
    """Maximal half-open runs ``[start_ts, end_ts)`` of samples where ``flag`` holds."""
    out = islands(frame.withColumn("__flag", flag), keys, [ts], [F.col("__flag")])
    return (
        out.groupBy(*keys, "island")
        .agg(F.min(ts).alias("start_ts"), (F.max(ts) + grid_ns).alias("end_ts"), F.count("*").alias("n"), F.first("__flag").alias("f"))
        .filter("f")
        .drop("f", "island")
    )


def warmup_cutoff(frame: DataFrame, keys: Sequence[str], grid_ns: int, min_consecutive: int = 3, min_levels: int = 1,
                  since: Column | None = None) -> DataFrame:
    """Time of the n-th consecutive valid sample (optionally counting only samples at or after ``since``)."""
    f = frame.filter(F.col("sample_ts") >= since) if since is not None else frame
    good = runs(f, keys, valid(min_levels), grid_ns)
    hit = F.min(F.when(F.col("n") >= min_consecutive, F.col("start_ts") + (min_consecutive - 1) * grid_ns))
    return f.select(*keys).distinct().join(good.groupBy(*keys).agg(hit.alias("cutoff_ts")), list(keys), "left")


def frozen_metrics(frame: DataFrame, keys: Sequence[str], level_cols: Sequence[str], grid_ns: int, min_run: int = 60) -> DataFrame:
    """Runs of at least ``min_run`` samples with identical top-K state, and the share of samples in them."""
    state = F.struct(*level_cols)
    r = (
        islands(frame, keys, ["sample_ts"], [state])
        .groupBy(*keys, "island")
        .agg(F.count("*").alias("n"), F.count_if(valid()).alias("n_valid"))
    )
    long = F.col("n") >= min_run
    return r.groupBy(*keys).agg(
        F.sum("n").alias("n_samples"),
        F.count_if(long).alias("n_frozen_runs"),
        F.coalesce(F.max(F.when(long, F.col("n"))), F.lit(0)).alias("max_frozen_run"),
        (F.sum(F.when(long, F.col("n")).otherwise(0)) / F.sum("n")).alias("frozen_fraction"),
        (F.sum(F.when(long, F.col("n_valid")).otherwise(0)) / F.sum("n")).alias("stale_but_uncrossed_fraction"),
    )


def silence_metrics(events: DataFrame, keys: Sequence[str], ts: str, tie: str, bars_s: Sequence[int] = (10, 60, 300),
                    width: int = DAY_NS) -> DataFrame:
    """Inter-event gaps on one clock: count, longest, counts above each bar, silent seconds."""
    g = shift(events, keys, [ts, tie], {"__p": F.col(ts)}, width=width)
    gap = (F.col(ts) - F.col("__p")) / 1e9
    return g.groupBy(*keys).agg(
        F.count("*").alias("n_events"),
        F.max(gap).alias("max_gap_s"),
        *[F.count_if(gap > b).alias(f"gaps_gt_{b}s") for b in bars_s],
        F.coalesce(F.sum(F.when(gap > bars_s[0], gap)), F.lit(0.0)).alias(f"silent_seconds_gt_{bars_s[0]}s"),
    )


def sustained_cross_trigger(frame: DataFrame, keys: Sequence[str], grid_ns: int, trigger_ns: int, after: Column | None = None) -> DataFrame:
    """First crossed run still crossed ``trigger_ns`` later; a run straddling ``after`` restarts there."""
    r = runs(frame, keys, crossed(), grid_ns).withColumn("last_ts", F.col("end_ts") - grid_ns)
    start = F.col("start_ts") if after is None else F.greatest(F.col("start_ts"), after)
    trig = start + trigger_ns
    ok = F.col("last_ts") >= trig
    if after is not None:
        ok = ok & (trig > after)
    hits = r.groupBy(*keys).agg(F.min(F.when(ok, trig)).alias("trigger_ts"))
    return frame.select(*keys).distinct().join(hits, list(keys), "left")


# ------------------------------------------------------------------ snapshot candidates
def classify_snapshot(min_levels: int = 1, max_spread_frac: float | None = None) -> Column:
    """First failing check of the ``bids`` / ``asks`` ladders, or ``ok``."""
    b, a = F.col("bids"), F.col("asks")

    def bad(x: Column) -> Column:
        def f(v: Column) -> Column:
            return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v <= 0)

        return f(x["px"]) | f(x["sz"])

    def unsorted(arr: Column, descending: bool) -> Column:
        pairs = F.arrays_zip(
            F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0))).alias("l"),
            F.slice(arr, 2, F.greatest(F.size(arr) - 1, F.lit(0))).alias("r"),
        )
        if descending:
            return F.exists(pairs, lambda p: p["l"]["px"] <= p["r"]["px"])
        return F.exists(pairs, lambda p: p["l"]["px"] >= p["r"]["px"])

    bb, ba = F.get(b, F.lit(0))["px"], F.get(a, F.lit(0))["px"]
    out = (
        F.when((F.size(b) == 0) | (F.size(a) == 0), "one_sided")
        .when(F.exists(b, bad) | F.exists(a, bad), "bad_values")
        .when((F.size(b) < min_levels) | (F.size(a) < min_levels), "thin_depth")
        .when(unsorted(b, True) | unsorted(a, False), "unsorted")
        .when(bb >= ba, "crossed")
    )
    if max_spread_frac is not None:
        out = out.when((ba - bb) / ((ba + bb) / 2.0) > max_spread_frac, "wide_spread")
    return out.otherwise("ok")


def classify_seed_candidate(requested: Column, max_age_ns: int, tick_scale: float | None, min_levels: int = 1,
                            max_spread_frac: float | None = None, ts: str = "sample_ts") -> Column:
    """Causality first (future, stale), then the ladder checks, then tick alignment."""
    base = classify_snapshot(min_levels, max_spread_frac)
    out = F.when(F.col(ts) > requested, "future").when(requested - F.col(ts) > max_age_ns, "stale").when(base != "ok", base)
    if tick_scale is not None:

        def off(x: Column) -> Column:
            return F.abs(x["px"] * tick_scale - F.rint(x["px"] * tick_scale)) > 1e-6

        out = out.when(F.exists("bids", off) | F.exists("asks", off), "off_tick")
    return out.otherwise("ok")


def preclassify_snapshots(snaps: DataFrame, keys: Sequence[str], min_levels: int = 1, max_spread_frac: float | None = None,
                          ts: str = "sample_ts") -> DataFrame:
    """Seed candidates per key: counts by reason, first accepted time, first rejection, crossed share."""
    c = snaps.withColumn("reason", classify_snapshot(min_levels, max_spread_frac))
    ok = F.col("reason") == "ok"
    n = F.count("*")
    out = c.groupBy(*keys).agg(
        n.alias("n_candidates"),
        *[F.count_if(F.col("reason") == x).alias(f"n_{x}") for x in ("ok", "one_sided", "bad_values", "thin_depth", "unsorted", "crossed", "wide_spread")],
        F.min(F.when(ok, F.col(ts))).alias("seed_ts"),
        F.min_by("reason", ts).alias("__first"),
        (F.count_if(F.col("reason") == "crossed") / n).alias("seed_source_crossed_frac"),
    )
    return out.withColumns(
        {
            "seed_accepted": F.col("seed_ts").isNotNull(),
            "seed_reason": F.when(F.col("seed_ts").isNotNull(), "ok").otherwise(F.col("__first")),
        }
    ).drop("__first")


@dataclass(frozen=True)
class QualityThresholds:
    """Day-quality bars (fixed values)."""

    crossed_usable_max: float = 0.01
    missing_usable_max: float = 0.02
    thin_usable_max: float = 0.10
    seed_crossed_frac_max: float = 0.05


def _codes(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules]))


def _over(t: QualityThresholds) -> Column:
    return _codes(
        (F.col("crossed_rate") > t.crossed_usable_max, "crossed_over_bar"),
        (F.col("missing_book_fraction") > t.missing_usable_max, "missing_over_bar"),
        (F.col("thin_depth_fraction") > t.thin_usable_max, "thin_depth_over_usable_bar"),
    )


def _seed_code() -> Column:
    none = F.col("seed_reason").isNull() | (F.col("seed_reason") == "no_snapshots")
    return F.when(none, F.lit("no_seed_snapshots")).otherwise(F.concat(F.lit("seed_rejected:"), F.col("seed_reason")))


def classify_day_quality(m: DataFrame, t: QualityThresholds = QualityThresholds()) -> DataFrame:
    """usable / degraded / missing / inconclusive with ordered reasons, from per-day metrics."""
    over = _over(t)
    no_seed = ~F.coalesce("seed_accepted", F.lit(False))
    unreliable = F.col("seed_source_crossed_frac") > t.seed_crossed_frac_max
    cls = (
        F.when(~F.col("have_book"), "missing")
        .when(no_seed | unreliable, "inconclusive")
        .when(F.size(over) > 0, "degraded")
        .otherwise("usable")
    )
    reasons = (
        F.when(~F.col("have_book"), F.array(F.lit("book_deltas_absent")))
        .when(no_seed, F.array(_seed_code()))
        .when(unreliable, F.array(F.lit("seed_accepted_but_source_unreliable")))
        .otherwise(F.concat(F.array(F.lit("seed_accepted")), over))
    )
    return m.withColumns({"classification": cls, "reasons": reasons})


def classify_replay(m: DataFrame, t: QualityThresholds = QualityThresholds()) -> DataFrame:
    """certified / degraded / inconclusive from replay metrics."""
    over = _over(t)
    no_seed = ~F.coalesce("seed_accepted", F.lit(False))
    unreliable = F.col("seed_source_crossed_frac") > t.seed_crossed_frac_max
    cls = F.when(no_seed | unreliable, "inconclusive").when(F.size(over) > 0, "degraded").otherwise("certified")
    reasons = (
        F.when(no_seed, F.array(_seed_code()))
        .when(unreliable, F.array(F.lit("seed_accepted_but_source_unreliable")))
        .otherwise(F.concat(F.array(F.lit("seed_accepted")), over))
    )
    return m.withColumns({"classification": cls, "reasons": reasons})


def fill_decision(classification: str = "classification", reasons: str = "reasons") -> dict[str, Column]:
    """``needs_fill`` (null = undecided) and ``why`` from a class and its reasons."""
    c = F.col(classification)
    unreliable = (c == "inconclusive") & F.array_contains(reasons, "seed_accepted_but_source_unreliable")
    needs = F.when((c == "missing") | (c == "degraded") | unreliable, True).when(c == "usable", False)
    why = (
        F.when(c == "missing", "book_deltas_absent")
        .when(c == "degraded", "quality_over_usable_bar")
        .when(unreliable, "crossed_seed_source")
        .when(c == "usable", "usable")
        .when(c == "excluded", "excluded_not_in_scope")
        .otherwise("no_verdict")
    )
    return {"needs_fill": needs, "why": why}
