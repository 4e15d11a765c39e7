"""Cost-aware evaluation of forecasts: PnL, Sharpe ratios, lift, bootstraps, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lobspark.operators.ordered import running
from lobspark.operators.stats import quantiles
from lobspark.session import DAY_NS


def net_pnl(f: str = "f", y: str = "y_fwd_bps", crossings: int = 2, margin_bps: float = 0.0) -> dict[str, Column]:
    """Trade when the forecast clears cost, spread crossings and margin; gross and net PnL."""
    total = F.col("cost_bps") + F.col("half_spread_bps") * crossings
    traded = F.abs(f) > total + margin_bps
    gross = F.when(traded, F.signum(f) * F.col(y)).otherwise(0.0)
    return {"traded": traded, "gross": gross, "pnl": F.when(traded, gross - total).otherwise(0.0)}


def trade_economics(f: str = "f", y: str = "y_fwd_bps", crossings: int = 2) -> dict[str, Column]:
    """Decide without the latency drift, pay with it; ``reconciles`` checks gross − cost = net."""
    spread = F.col("half_spread_bps") * crossings
    decide = F.col("cost_bps") - F.col("latency_drift_bps") + spread
    paid = F.col("cost_bps") + spread
    traded = F.abs(f) > decide
    gross = F.when(traded, F.signum(f) * F.col(y)).otherwise(0.0)
    cost = F.when(traded, paid).otherwise(0.0)
    net = F.when(traded, F.signum(f) * F.col(y) - paid).otherwise(0.0)
    return {"traded": traded, "gross": gross, "cost": cost, "net": net, "reconciles": F.abs(gross - cost - net) <= 1e-12}


def weighted_moments(rows: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Count, weight sum, weighted mean and population variance per key, in two passes."""
    keys = list(keys)
    v, w = F.col(value), F.col(weight)
    mean = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("w_sum"), (F.sum(w * v) / F.sum(w)).alias("w_mean"))
    var = (
        rows.join(mean.select(*keys, "w_mean"), keys)
        .groupBy(*keys)
        .agg((F.sum(w * (v - F.col("w_mean")) ** 2) / F.sum(w)).alias("w_var"))
    )
    return mean.join(var, keys)


def weighted_sharpe(rows: DataFrame, keys: Sequence[str], traded_only: bool = True, pnl: str = "pnl", weight: str = "uniqueness") -> DataFrame:
    """Weighted mean over (weighted std + 1e-12); 0 when fewer than two rows or no variance."""
    keys = list(keys)
    m = weighted_moments(rows.filter("traded") if traded_only else rows, keys, pnl, weight)
    sharpe = F.when((F.col("n") >= 2) & (F.col("w_var") > 0), F.col("w_mean") / (F.sqrt("w_var") + 1e-12)).otherwise(0.0)
    every = rows.select(*keys).distinct()
    return every.join(m.select(*keys, sharpe.alias("sharpe")), keys, "left").withColumn("sharpe", F.coalesce("sharpe", F.lit(0.0)))


def weighted_trade_sharpe(rows: DataFrame, keys: Sequence[str], pnl: str = "pnl", weight: str = "uniqueness") -> DataFrame:
    keys = list(keys)
    m = weighted_moments(rows.filter("traded"), keys, pnl, weight)
    x = rows.select(*keys).distinct().join(m, keys, "left")
    reason = (
        F.when(F.coalesce("n", F.lit(0)) < 2, "fewer_than_two_traded_rows")
        .when(~(F.col("w_sum") > 0), "zero_weight_sum")
        .when(~(F.col("w_var") > 0), "zero_weighted_variance")
    )
    return x.select(*keys, F.when(reason.isNull(), F.col("w_mean") / F.sqrt("w_var")).otherwise(0.0).alias("sharpe"), reason.alias("reason"))


def weighted_lift(rows: DataFrame, keys: Sequence[str], y: str = "y_fwd_bps", f: str = "f", weight: str = "uniqueness") -> DataFrame:
    u, a, b = F.col(weight), F.col(y), F.col(f)
    s = rows.groupBy(*keys).agg(F.sum(u * a * a).alias("zero"), F.sum(u * (a - b) ** 2).alias("model"))
    reason = F.when(F.col("zero") == 0, "zero_persistence_denominator")
    return s.select(*keys, F.when(reason.isNull(), 1.0 - F.col("model") / F.col("zero")).alias("lift"), reason.alias("reason"))


def trade_summary(rows: DataFrame, keys: Sequence[str], weight: str = "uniqueness") -> DataFrame:
    """Trades, turnover, effective trades, gross, net and the cost wall between them."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count_if("traded").alias("n_trades"),
        (F.count_if("traded") / F.count("*")).alias("turnover"),
        F.coalesce(F.sum(F.when(F.col("traded"), F.col(weight))), F.lit(0.0)).alias("effective_trades"),
        F.sum("gross").alias("gross_pnl"),
        F.sum("pnl").alias("net_pnl"),
        (F.sum("gross") - F.sum("pnl")).alias("cost_wall"),
    )


def mcc(rows: DataFrame, keys: Sequence[str], f: str = "f", y: str = "y_fwd_bps") -> DataFrame:
    """Multiclass Matthews correlation of sign(f) and sign(y) over trades; 0 when degenerate."""
    p, t = F.signum(f).cast("int"), F.signum(y).cast("int")
    hit = F.col("traded")
    cls = (-1, 0, 1)
    a = rows.groupBy(*keys).agg(
        F.count_if(hit).alias("s"),
        F.count_if(hit & (p == t)).alias("c"),
        *[F.count_if(hit & (p == k)).alias(f"p{k + 1}") for k in cls],
        *[F.count_if(hit & (t == k)).alias(f"t{k + 1}") for k in cls],
    )
    d = {n: F.col(n).cast("double") for n in ("s", "c", "p0", "p1", "p2", "t0", "t1", "t2")}
    pt = d["p0"] * d["t0"] + d["p1"] * d["t1"] + d["p2"] * d["t2"]
    pp = d["p0"] ** 2 + d["p1"] ** 2 + d["p2"] ** 2
    tt = d["t0"] ** 2 + d["t1"] ** 2 + d["t2"] ** 2
    den = F.sqrt((d["s"] ** 2 - pp) * (d["s"] ** 2 - tt))
    kinds = sum(((F.col(f"p{i}") > 0).cast("int") for i in (1, 2)), (F.col("p0") > 0).cast("int"))
    ok = (F.col("s") > 1) & (kinds > 1) & (den > 0)
    return a.select(*keys, F.when(ok, (d["c"] * d["s"] - pt) / F.when(den > 0, den)).otherwise(0.0).alias("mcc"))


def sample_skew_kurt(rows: DataFrame, keys: Sequence[str], value: str = "pnl") -> DataFrame:
    """Bias-corrected skew and Pearson kurtosis (0 and 3 for tiny or constant samples)."""
    keys = list(keys)
    mean = rows.groupBy(*keys).agg(F.avg(value).alias("__m"), F.count("*").alias("__n"))
    c = F.col(value) - F.col("__m")
    m = (
        rows.join(mean, keys)
        .groupBy(*keys)
        .agg(F.first("__n").cast("double").alias("n"), *[F.sum(F.pow(c, i)).alias(f"m{i}") for i in (2, 3, 4)])
    )
    n, m2, m3, m4 = (F.col(x) for x in ("n", "m2", "m3", "m4"))
    skew = F.when((n > 2) & (m2 > 0), F.sqrt(n * (n - 1)) / (n - 2) * (m3 / n) / F.pow(m2 / n, 1.5)).otherwise(0.0)
    var = m2 / (n - 1)
    kurt = n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * m4 / (var * var) - (n - 1) ** 2 * 3 / ((n - 2) * (n - 3)) + 3.0
    return m.select(*keys, F.col("n").cast("bigint").alias("n"), skew.alias("skew"), F.when((n > 3) & (m2 > 0), kurt).otherwise(3.0).alias("kurt"))


def dsr_sample_count(effective: Column) -> Column:
    """Rounded half to even, at least two."""
    return F.greatest(F.lit(2), F.bround(effective, 0).cast("bigint")).cast("bigint")


def per_regime(rows: DataFrame, keys: Sequence[str], pnl: str = "pnl", weight: str = "uniqueness") -> DataFrame:
    keys = [*keys, "regime"]
    base = rows.groupBy(*keys).agg(F.sum(pnl).alias("net_pnl"), F.count(pnl).alias("n"))
    return base.join(weighted_sharpe(rows, keys, traded_only=False, pnl=pnl, weight=weight).withColumnRenamed("sharpe", "sample_sharpe"), keys)


def matched_delta(pnl: DataFrame, arm: str, combined: str, control: str, row_keys: Sequence[str], config: Sequence[str]) -> DataFrame:
    """Best combined-arm config against the control arm's same config on paired rows."""
    best = (
        pnl.filter(F.col(arm) == combined)
        .groupBy(*config)
        .agg(F.sum("pnl").alias("__t"))
        .orderBy(F.desc("__t"), *config)
        .limit(1)
        .select(*config)
    )
    a = pnl.filter(F.col(arm) == combined).join(F.broadcast(best), list(config)).select(*row_keys, *config, F.col("pnl").alias("a"))
    b = pnl.filter(F.col(arm) == control).select(*row_keys, *config, F.col("pnl").alias("b"))
    return a.join(b, [*row_keys, *config]).filter("a IS NOT NULL AND b IS NOT NULL").select(*row_keys, *config, (F.col("a") - F.col("b")).alias("delta"))


def rank_candidates(cands: DataFrame, mode: str) -> DataFrame:
    """Descending lexicographic order with ladder-order ties (a handful of candidates)."""
    cols = {"trade": ("net_lower_bound", "lift_lower_bound", "point_net", "point_lift"), "predictive": ("lift_lower_bound", "point_lift")}[mode]
    w = W.orderBy(*[F.desc(c) for c in cols], "ladder_index")
    return cands.withColumn("position", F.row_number().over(w).cast("bigint"))


def gate_verdict(c: DataFrame, *, dsr_min: float, min_trades: int, min_effective: float, min_sharpe: float, pbo_max: float, keys: Sequence[str] = (), eligible: Column | None = None) -> DataFrame:
    """Per-candidate pass with reasons, the PBO fail-closed gate and the winner by net PnL inside each of ``keys``.

    ``c``: name, net_pnl, naive_net, dsr, n_trades, effective_trades, sample_sharpe, pbo (null = unavailable). Candidates that are not
    ``eligible`` count as trials but never win.
    """
    rules = [
        (~(F.col("net_pnl") > 0), "net_not_positive"),
        (~(F.col("net_pnl") > F.col("naive_net")), "not_above_naive"),
        (~(F.col("dsr") > dsr_min), "dsr_not_above_threshold"),
        (F.col("n_trades") < min_trades, "insufficient_trades"),
        (~(F.col("effective_trades") >= min_effective), "insufficient_effective_trades"),
        (~(F.col("sample_sharpe") >= min_sharpe), "sample_sharpe_below_minimum"),
    ]
    why = F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(True)), F.lit(n)) for r, n in rules]))
    x = c.withColumn("reasons", F.array_join(why, ",")).withColumn("passes_solo", F.col("reasons") == "")
    can = F.col("passes_solo") & (eligible if eligible is not None else F.lit(True))
    w = W.partitionBy(*keys).orderBy(F.desc(can), F.desc("net_pnl"), "name")  # a handful of candidates
    x = x.withColumn("is_winner", (F.row_number().over(w) == 1) & can)
    ok = F.coalesce(F.col("pbo") < pbo_max, F.lit(False))
    verdict = F.when(~F.col("is_winner"), None).when(F.col("pbo").isNull(), "inconclusive").when(ok, "pass").otherwise("fail")
    return x.withColumn("verdict", verdict)


# ------------------------------------------------------------------ horizon decay
def predictivity_curve(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.pow(F.corr(x, y), 2).alias("r2"))


def estimate_tau(curve: DataFrame, horizon: str = "horizon_ns", frac: float = 0.3679) -> DataFrame:
    """First crossing of ``frac`` × max of the curve, linearly interpolated; else the last horizon."""
    w = W.orderBy(horizon)  # one row per horizon
    c = curve.withColumns({"x0": F.lag(horizon).over(w), "y0": F.lag("r2").over(w), "thr": F.max("r2").over(W.partitionBy()) * frac})
    x1, y1 = F.col(horizon), F.col("r2")
    cross = (y1 < F.col("thr")) & (F.col("thr") <= F.col("y0"))
    at = F.col("x0") + (x1 - F.col("x0")) * (F.col("y0") - F.col("thr")) / (F.col("y0") - y1 + 1e-12)
    return c.agg(F.coalesce(F.min_by(F.when(cross, at), F.when(cross, x1)), F.max(x1).cast("double")).alias("tau"))


# ------------------------------------------------------------------ bootstraps
def hash_index(parts: Sequence[Column], n: Column) -> Column:
    """Deterministic pseudo-random integer in [0, n) from md5 of the parts."""
    h = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12)
    return F.pmod(F.conv(h, 16, 10).cast("bigint"), n)


def numbered(rows: DataFrame, order: Sequence[str], value: Column, width: int = DAY_NS) -> DataFrame:
    """``i`` (1-based position in ``order``) and ``p`` (the value there)."""
    x = rows.withColumn("__p", value.cast("double"))
    return running(x, [], list(order), {"i": ("sum", F.lit(1).cast("bigint"))}, width=width).select("i", F.col("__p").alias("p"))


def moving_block_sums(series: DataFrame, n: int, block: int) -> DataFrame:
    """``start, full, tail`` for every position (from 0) of a circular series ``i, p`` of ``n`` rows.

    ``full`` sums ``block`` values from ``start`` on, ``tail`` the ``n mod block`` values (``block`` if that is zero) of a replicate's last
    block. A row lies in its own group of ``block`` positions and the one before, so a window never holds more than two blocks, and a
    sum is never a difference of sums over the whole series. A null value counts as zero; a series shorter than a block has no rows.
    """
    last = (n % block) or block
    at = series.select((F.col("i") - 1).cast("bigint").alias("i"), F.coalesce(F.col("p").cast("double"), F.lit(0.0)).alias("v")).filter(F.lit(n >= block))
    around = at.unionByName(at.filter(F.col("i") < block).withColumn("i", F.col("i") + F.lit(n).cast("bigint")))
    own = F.expr(f"i div {block}L")
    near = around.withColumn("g", F.explode(F.array(own, own - 1)))
    w = W.partitionBy("g").orderBy("i")
    near = near.withColumn("c", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)))
    ahead = lambda k: F.lead("c", k - 1).over(w) - F.col("c") + F.col("v")
    near = near.withColumns({"full": ahead(block), "tail": ahead(last)})
    return near.filter((F.col("g") == own) & (F.col("i") < n)).select(F.col("i").alias("start"), "full", "tail")


def block_bootstrap(series: DataFrame, *, n_boot: int, block: int, seed: int) -> DataFrame:
    """Total of each circular block-bootstrap replicate of a series ``i, p``: ``rep, total``.

    Draws are counted in the tasks that make them, one row per distinct start with the replicates that drew it, so the join reads each start once
    and at most ``n`` rows a side; totals are summed in the tasks before the last shuffle, which holds one row per replicate and task.
    """
    spark, n = series.sparkSession, series.agg(F.count("*")).first()[0]
    blocks = -(-n // block) if n >= block else 0
    many, some = n_boot * blocks, max(blocks, 1)
    draws = spark.range(0, many, 1, max(spark.sparkContext.defaultParallelism, many // 4_000_000)).selectExpr(f"id div {some}L rep", f"id % {some}L j")
    draws = draws.withColumn("start", hash_index([F.lit(seed), F.col("rep"), F.col("j")], F.lit(max(n, 1)).cast("bigint")))
    ends = F.col("j") == blocks - 1
    by_start = draws.groupBy("start").agg(F.collect_list(F.when(~ends, F.col("rep"))).alias("of_full"), F.collect_list(F.when(ends, F.col("rep"))).alias("of_tail"))
    parts = [F.expr(f"transform(of_{v}, x -> struct(x AS rep, {v} AS part))") for v in ("full", "tail")]
    return by_start.join(moving_block_sums(series, n, block), "start").select(F.inline(F.concat(*parts))).groupBy("rep").agg(F.sum("part").alias("total"))


def bootstrap_band(replicates: DataFrame, alpha: float, col: str = "total") -> DataFrame:
    """``band_low, band_high``: always one row, null where there are no replicates."""
    q = quantiles(replicates, [], {"band": F.col(col)}, {"low": alpha / 2, "high": 1 - alpha / 2})
    return q.agg(*[F.max(c).alias(c) for c in ("band_low", "band_high")])


def lower_bound(replicates: DataFrame, alpha: float, col: str) -> DataFrame:
    return quantiles(replicates, [], {"q": F.col(col)}, {"lower": alpha}).withColumnRenamed("q_lower", "lower_bound")


def day_sums(rows: DataFrame, day: Column, sums: dict[str, Column]) -> DataFrame:
    return rows.groupBy(day.alias("day")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def day_bootstrap(days: DataFrame, cols: Sequence[str], *, n_boot: int, seed: int) -> DataFrame:
    """Circular two-day-block replicates over day sums: ``rep`` and the drawn total of each column.

    ``days`` has one row per included day, a calendar-sized table.
    """
    spark = days.sparkSession
    d = days.withColumn("i", F.row_number().over(W.orderBy("day")) - 1)
    n = d.agg(F.count("*").alias("n"))
    reps = spark.range(n_boot).withColumnRenamed("id", "rep").crossJoin(F.broadcast(n))  # one row
    reps = reps.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    start = hash_index([F.lit(seed), F.col("rep"), F.expr("j div 2")], F.col("n"))
    reps = reps.withColumn("i", F.pmod(start + F.col("j") % 2, F.col("n")))
    return reps.join(d.select("i", *cols), "i").groupBy("rep").agg(F.max("n").alias("n_days"), *[F.sum(c).alias(c) for c in cols])
