"""Assembly of the model matrix: gates in a fixed first-failure order, then labels and weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lobspark.functions.normalize import log_return_bps, spread_regime
from lobspark.operators import bars as B
from lobspark.operators import contracts as K
from lobspark.operators import labels as L
from lobspark.operators.book import coalesce_path, day_of, day_open, invalid_intervals, mid_path_with_opens, open_points, quote_path
from lobspark.operators.features import FEATURE_COLS, build_features
from lobspark.operators.ordered import range_join
from lobspark.operators.reads import bar_costs, dual_book_reads
from lobspark.session import DAY_NS, HOUR_NS, materialize
from lobspark.sources.publish import StageChecks, publish

# Drop categories in the order they are checked.
DROP_CATEGORIES = (
    "warmup", "day_end_truncation", "book_rejection", "staleness", "feature_rejection", "before_start",
    "lookback_cap", "prefilter", "coverage_gap", "label_rejection", "actual_span",
)


@dataclass(frozen=True)
class MatrixParams:
    horizons: Mapping[str, int] = field(default_factory=lambda: dict(L.DEFAULT_HORIZONS))
    time_cap_ns: int = 7 * HOUR_NS
    window_days: int = 7
    warmup_days: int = 2
    target_bars: int = 500
    seed_threshold: float = 1e6
    staleness_cap_ns: int = 5_000_000_000
    top_k: int = 10
    tick_size: float = 0.01
    taker_fee_bps: float = 1.0
    base_slippage_bps: float = 0.1
    lookback_cap_ns: int = 8 * HOUR_NS
    guard_ns: int = 60_000_000_000
    partition_start_ns: int = 0
    partition_end_ns: int = 1 << 62
    halflife_ns: int = 60_000_000_000
    min_returns: int = 100
    width_mult: float = 1.0
    vol_floor_bps: float = 0.0
    regime_boundary_ticks: float = 1.0
    width_ns: int = DAY_NS  # time bucket of every chunked step; at most a day, at least the longest horizon


def contiguous_segments(days: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Runs of consecutive included days: ``keys, dt, seg, seg_start_ns, seg_end_ns``."""
    keys = list(keys)
    n = F.datediff("dt", F.lit("1970-01-01").cast("date"))
    d = days.select(*keys, "dt").distinct()
    d = d.withColumn("__g", n - F.row_number().over(W.partitionBy(*keys).orderBy("dt")))
    run = W.partitionBy(*keys, "__g")
    return d.select(
        *keys,
        "dt",
        F.min("dt").over(run).alias("seg"),
        day_open_of(F.min("dt").over(run)).alias("seg_start_ns"),
        (day_open_of(F.max("dt").over(run)) + DAY_NS).alias("seg_end_ns"),
    )


def day_open_of(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) * 1000


def horizon_rows(cand: DataFrame, horizons: Mapping[str, int]) -> DataFrame:
    """Candidates times horizons (a fixed handful), as an explode instead of a cross join."""
    cells = F.array(*[F.struct(F.lit(t).alias("horizon"), F.lit(n).alias("horizon_ns")) for t, n in horizons.items()])
    return cand.withColumn("__h", F.explode(cells)).select(*cand.columns, "__h.horizon", "__h.horizon_ns")


def prefilter_reason(guard_ns: int, end_ns: int) -> Column:
    """Windows reaching the partition end, or leaving their contiguous day segment."""
    upper = F.col("t_event") + F.col("horizon_ns") + guard_ns
    return F.when(upper >= end_ns, "prefilter").when((F.col("seg_end_ns") < end_ns) & (upper >= F.col("seg_end_ns")), "coverage_gap")


def invalid_window_hits(rows: DataFrame, spans: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Row keys whose ``(t_event, t_barrier]`` meets an invalid interval ``[start_ns, end_ns)``."""
    p = rows.select(*keys, "t_event", "horizon", (F.col("t_event") + 1).alias("__lo"), F.col("t_barrier").alias("__hi"))
    s = spans.select(*keys, F.col("start_ns").alias("__s"), (F.col("end_ns") - 1).alias("__e"))
    j = range_join(p, s, keys, point_lo="__lo", point_hi="__hi", span_lo="__s", span_hi="__e", width=width)
    return j.select(*keys, "t_event", "horizon").distinct()


def decisions(trades: DataFrame, days: DataFrame, p: MatrixParams) -> DataFrame:
    """Coalesced bars over the included days."""
    totals = days.select("symbol", "dt").join(B.day_totals(trades), ["symbol", "dt"], "left")
    totals = totals.withColumns({"notional": F.coalesce("notional", F.lit(0.0)), "coverage": F.lit(1.0)})
    schedule = B.threshold_schedule(
        totals, window_days=p.window_days, warmup_days=p.warmup_days, target_bars=p.target_bars, seed_threshold=p.seed_threshold
    )
    kept = trades.join(days.select("symbol", "dt"), ["symbol", "dt"], "left_semi")
    bars = materialize(B.dollar_bars(kept, schedule, p.time_cap_ns))
    return B.coalesce_bars(B.decision_watermark(bars))


def candidate_rows(bars: DataFrame, reads: DataFrame, segments: DataFrame, p: MatrixParams) -> DataFrame:
    """Every decision with its features, costs and bar-level ``drop_reason`` (null = candidate)."""
    x = bars.join(reads, ["symbol", "t_event"]).join(segments, ["symbol", "dt"])
    end_like = (F.col("close_reason") == "day_end") | (F.col("t_event") >= day_open() + DAY_NS)
    x = materialize(x.withColumn("day_end_like", end_like))
    survived = F.col("reason").isNull() & ~F.col("day_end_like")
    feats = build_features(x.filter(survived), p.top_k, p.tick_size, width=p.width_ns)
    feats = feats.withColumns(bar_costs(p.taker_fee_bps, p.base_slippage_bps))
    look = F.col("t_event") - F.col("t_feature_start")
    floor_ns = F.greatest(F.col("seg_start_ns"), F.lit(p.partition_start_ns))
    feats = feats.withColumn(
        "drop_reason",
        F.when(F.col("is_warmup"), "warmup")
        .when(F.col("feature_reason").isNotNull(), "feature_rejection")
        .when(F.col("t_feature_start") < floor_ns, "before_start")
        .when(look > p.lookback_cap_ns, "lookback_cap"),
    )
    lost = x.filter(~survived).withColumn(
        "drop_reason",
        F.when(F.col("is_warmup"), "warmup")
        .when(F.col("day_end_like"), "day_end_truncation")
        .when(F.col("reason") == "stale_book", "staleness")
        .otherwise("book_rejection"),
    )
    return feats.unionByName(lost, allowMissingColumns=True)


def label_rows(cand: DataFrame, path: DataFrame, p: MatrixParams) -> DataFrame:
    """Candidate × horizon rows with ``drop_reason`` after prefilter and labelling."""
    h = horizon_rows(cand, p.horizons).withColumn("drop_reason", prefilter_reason(p.guard_ns, p.partition_end_ns))
    vol = materialize(L.ewma_vol(path, ["symbol", "seg"], p.halflife_ns))
    anchors = cand.select("symbol", "seg", "t_event", F.col("label_mid").alias("p0"))
    widths = L.anchors_with_width(
        vol, anchors, ["symbol", "seg"], width_mult=p.width_mult, vol_floor_bps=p.vol_floor_bps, min_returns=p.min_returns, width=p.width_ns
    ).select("symbol", "seg", "t_event", "p0", "path_mid", "vol_bps", "n_returns", "width_bps", "label_reason")
    h = h.join(widths, ["symbol", "seg", "t_event"])
    h = materialize(
        h.withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("label_reason").isNotNull(), "label_rejection")))
    )
    live = h.filter(F.col("drop_reason").isNull())
    lab = L.triple_barrier(path, live, ["symbol", "seg"], longest=max(p.horizons.values())).drop("p0", "width_bps")
    return h.join(lab, ["symbol", "seg", "t_event", "horizon"], "left")


def span_gates(rows: DataFrame, invalid: DataFrame, p: MatrixParams) -> DataFrame:
    """Resolved windows crossing an invalid book, then guarded spans leaving segment or partition."""
    bad = invalid_window_hits(rows.filter("drop_reason IS NULL"), invalid, ["symbol"], p.width_ns).withColumn("__hit", F.lit(True))
    x = rows.join(bad, ["symbol", "t_event", "horizon"], "left")
    bound = F.least("seg_end_ns", F.lit(p.partition_end_ns))
    reason = F.coalesce(
        F.col("drop_reason"),
        F.when(F.col("__hit"), "coverage_gap").when(F.col("t_barrier") + p.guard_ns >= bound, "actual_span"),
    )
    return x.withColumn("drop_reason", reason).drop("__hit")


def assemble(rows: DataFrame, p: MatrixParams) -> DataFrame:
    """Surviving rows in manifest column order with published returns, regime and uniqueness."""
    keep = rows.filter("drop_reason IS NULL").select(
        "symbol",
        "horizon",
        "t_event",
        "t_barrier",
        "t_feature_start",
        F.col("t_event").alias("t_available"),
        *FEATURE_COLS,
        log_return_bps(F.col("y_fwd_bps")).alias("y_fwd_bps"),
        "label",
        "cost_bps",
        "half_spread_bps",
        "latency_drift_bps",
        (F.col("close_reason") == "time_cap").alias("emitted_by_time_cap"),
        spread_regime(F.col("spread_tick"), p.regime_boundary_ticks).alias("regime"),
    )
    return L.uniqueness(keep, ["symbol", "horizon"], p.width_ns)


@dataclass
class MatrixBuild:
    """Intermediate tables of one build, each stored once."""

    matrix: DataFrame
    rows: DataFrame
    candidates: DataFrame
    bars: DataFrame
    reads: DataFrame
    path: DataFrame
    invalid: DataFrame


def model_matrix(trades: DataFrame, deltas: DataFrame, days: DataFrame, p: MatrixParams, checks: StageChecks | None = None) -> MatrixBuild:
    """Trades and book deltas of the included days to the model matrix; ``checks`` counts the rules of every stage while it is stored."""

    def stored(stage: str, df: DataFrame, rules: Mapping[str, Column], where: Column | None = None) -> DataFrame:
        if checks is None:
            return materialize(df)
        return checks.store(stage, df, {n: where & c for n, c in rules.items()} if where is not None else rules)

    segments = materialize(contiguous_segments(days))
    bars = stored("bars", decisions(trades, days, p), K.bar_rules())
    reads = stored("reads", dual_book_reads(deltas, bars, staleness_cap_ns=p.staleness_cap_ns, top_k=p.top_k, width=p.width_ns), K.read_rules(p.top_k))
    quotes = materialize(quote_path(deltas, width=p.width_ns))
    opens = materialize(open_points(deltas, days, width=p.width_ns))
    included = segments.select("symbol", "dt", "seg")
    path = coalesce_path(mid_path_with_opens(quotes, opens)).withColumn("dt", day_of("ts"))
    path = path.join(included, ["symbol", "dt"]).select("symbol", "seg", "ts", "mid")
    path = stored("path", path if checks is None else K.with_previous(path, ["symbol", "seg"]), K.path_rules())
    invalid = invalid_intervals(quotes, opens).join(included, ["symbol", "dt"], "left_semi")
    cand = stored("costs", candidate_rows(bars, reads, segments, p), K.cost_rules(), F.col("drop_reason").isNull())
    rows = label_rows(cand.filter("drop_reason IS NULL").drop("drop_reason"), path, p)
    rows = stored("spans", span_gates(materialize(rows), invalid, p), K.span_rules(), F.col("drop_reason").isNull())
    return MatrixBuild(assemble(rows, p), rows, cand, bars, reads, path, invalid)


def write_matrix(build: MatrixBuild, path: str, checks: StageChecks | None = None) -> int:
    """Publish the matrix in its column order, by horizon; keys are unique and every matrix and stage rule holds, else ``ContractBreach``."""
    K.require_columns(build.matrix, FEATURE_COLS)
    return publish(build.matrix, path, keys=["symbol", "t_event"], rules=K.matrix_rules(FEATURE_COLS), partitions=["horizon"], checks=checks)


def drop_counts(build: MatrixBuild, horizons: Mapping[str, int]) -> DataFrame:
    """First-failure counts per category and horizon (bar-level drops count once per horizon)."""
    early = horizon_rows(build.candidates.filter("drop_reason IS NOT NULL").select("drop_reason"), horizons)
    every = early.select("drop_reason", "horizon").unionByName(
        build.rows.filter("drop_reason IS NOT NULL").select("drop_reason", "horizon")
    )
    return every.groupBy(F.col("drop_reason").alias("category"), "horizon").agg(F.count("*").alias("n"))


def max_lookback(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.max(F.col("t_event") - F.col("t_feature_start")).alias("max_lookback_ns"))


def lookback_cap(rows: DataFrame, cap_ns: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows dropped above the cap and the largest retained look-back."""
    look = F.col("t_event") - F.col("t_feature_start")
    return rows.groupBy(*by).agg(
        F.count_if(look > cap_ns).alias("n_dropped"), F.max(F.when(look <= cap_ns, look)).alias("retained_max_lookback_ns")
    )


def span_violations(rows: DataFrame, horizons: Mapping[str, int], *, lo_ns: int, boundary_ns: int, guard_ns: int) -> DataFrame:
    """Per horizon: rows before the start, failing the conservative prefilter, or the actual span."""
    h = F.lit(None).cast("bigint")
    for tag, n in horizons.items():
        h = F.when(F.col("horizon") == tag, F.lit(n)).otherwise(h)
    return rows.groupBy("horizon").agg(
        F.count_if(F.col("t_event") < lo_ns).alias("before_start"),
        F.count_if(F.col("t_event") >= F.lit(boundary_ns) - h - guard_ns).alias("prefilter"),
        F.count_if(F.col("t_barrier") >= boundary_ns - guard_ns).alias("actual_span"),
    )
