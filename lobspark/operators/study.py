"""The study of one matrix: ladder, deflated Sharpe ratio, probability of overfitting and gate, inside each horizon."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.functions.normal import deflated_sharpe
from lobspark.operators import cv
from lobspark.operators import evaluate as E
from lobspark.operators.boost import RUNGS, BoostParams
from lobspark.session import DAY_NS, materialize

#: Rows that every half split of eight blocks needs before the probability of overfitting is told.
PBO_ROWS, PBO_BLOCKS = 32, 8


@dataclass(frozen=True)
class Gate:
    dsr_min: float = 0.95
    pbo_max: float = 0.5
    min_trades: int = 30
    min_effective: float = 10.0
    min_sharpe: float = 0.0
    extra_trials: int = 0


def check_lookback(matrix: DataFrame, *, embargo_ns: int, max_lookback_ns: int) -> None:
    """Raise unless the embargo covers the declared look-back and this the rows' own (``t_event - t_feature_start``)."""
    if embargo_ns < max_lookback_ns:
        raise ValueError(f"embargo of {embargo_ns} ns does not cover the look-back of {max_lookback_ns} ns")
    seen = matrix.agg(F.max(F.col("t_event") - F.col("t_feature_start"))).first()[0]
    if seen is not None and seen > max_lookback_ns:
        raise ValueError(f"rows look back {seen} ns, more than the declared {max_lookback_ns} ns")


def candidates(pnl: DataFrame, keys: Sequence[str], gate: Gate = Gate(), width: int = DAY_NS) -> DataFrame:
    """One row per key and rung: trade figures, Sharpe ratios, ``dsr``, ``pbo`` (null: too few rows) and the naive rung's net PnL.

    ``pnl``: keys, t_event, model, f, y_fwd_bps, uniqueness, traded, gross, pnl; every rung on the same rows.
    """
    keys = list(keys)
    own = [*keys, "model"]
    s = E.trade_summary(pnl, own)
    sk = E.sample_skew_kurt(pnl.filter("traded"), own).drop("n")
    sh = E.weighted_trade_sharpe(pnl, own).select(*own, F.col("sharpe").alias("trade_sharpe"))
    sa = E.weighted_sharpe(pnl, own, traded_only=False).withColumnRenamed("sharpe", "sample_sharpe")
    c = s.join(sk, own, "left").join(sh, own).join(sa, own).join(E.mcc(pnl, own), own)
    spread = c.groupBy(*keys).agg(F.stddev_pop("trade_sharpe").alias("sd"), F.greatest(F.lit(2), F.count("*") + gate.extra_trials).alias("n_tr"))
    blk = cv.block_index(pnl.filter("model = 'naive'").select(*keys, "t_event"), PBO_BLOCKS, width, keys)
    perf = pnl.join(blk, [*keys, "t_event"]).groupBy(*keys, "block", F.col("model").alias("trial")).agg(F.sum(F.col("uniqueness") * F.col("pnl")).alias("swp"), F.sum("uniqueness").alias("sw"))
    p = cv.pbo_logits(perf, PBO_BLOCKS, keys=keys).groupBy(*keys).agg(F.avg((F.col("logit") < 0).cast("double")).alias("pbo"))
    naive = c.filter("model = 'naive'").select(*keys, F.col("net_pnl").alias("naive_net"))
    c = c.join(spread, keys).join(p, keys, "left").join(naive, keys)
    dsr = deflated_sharpe(F.col("trade_sharpe"), F.col("sd"), F.col("n_tr"), E.dsr_sample_count(F.col("effective_trades")), F.coalesce("skew", F.lit(0.0)), F.coalesce("kurt", F.lit(3.0)))
    return c.withColumns({"dsr": dsr, "pbo": F.when(F.col("n_rows") >= PBO_ROWS, F.col("pbo"))})


def run_study(
    matrix: DataFrame, *, features: Sequence[str], micro: str, n_groups: int, k: int, embargo_ns: int, max_lookback_ns: int,
    keys: Sequence[str] = ("horizon",), keep: Sequence[str] = (), boost: BoostParams = BoostParams(), gate: Gate = Gate(), width: int = DAY_NS,
) -> tuple[DataFrame, DataFrame]:
    """All rungs on every horizon: the candidates with reasons and verdict, and the winners' figures by regime.

    Only boosted rungs can win a horizon; the others are trials that deflate the Sharpe ratio and enter the probability of overfitting.
    ``keep`` needs the outcome, costs, uniqueness and regime, and must tell rows of one instant apart.
    """
    keys = list(keys)
    check_lookback(matrix, embargo_ns=embargo_ns, max_lookback_ns=max_lookback_ns)
    ladder = cv.cv_ladder(matrix, features=features, micro=micro, n_groups=n_groups, k=k, embargo_ns=embargo_ns, width=width, keys=keys, keep=keep, boost=boost)
    pnl = materialize(ladder.withColumns(E.net_pnl()))
    c = candidates(pnl, keys, gate, width).withColumn("name", F.concat_ws("/", *keys, "model"))
    limits = {"dsr_min": gate.dsr_min, "min_trades": gate.min_trades, "min_effective": gate.min_effective, "min_sharpe": gate.min_sharpe, "pbo_max": gate.pbo_max}
    out = materialize(E.gate_verdict(c, **limits, keys=keys, eligible=F.col("model").isin(*RUNGS)))
    won = pnl.join(out.where("is_winner").select(*keys, "model"), [*keys, "model"], "left_semi")
    return out, E.per_regime(won, [*keys, "model"])
