"""Two reads of the same book per decision: what was observable, and what was true.

Events are ordered on the origin clock and gated on the received clock. In received order an event
changes the observable book only if its (origin, seq) key beats every earlier-received event of its
level, so the observable book is an ordinary last-write-wins fold over those winning events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.operators.book import book_asof, top_validity
from lobspark.operators.ordered import running
from lobspark.session import DAY_NS


def observable_deltas(deltas: DataFrame, keys: Sequence[str] = ("symbol",), width: int = DAY_NS) -> DataFrame:
    """Events that win their level at the moment they are received, one per (level, receipt)."""
    lvl = [*keys, "side", "tick"]
    d = deltas.withColumn("__k", F.struct("origin_ns", "seq"))
    d = running(d, lvl, ["received_ns", "origin_ns", "seq"], {"__top": ("max", F.col("__k"))}, width=width, inclusive=False)
    won = d.filter(F.col("__top").isNull() | (F.col("__k") > F.col("__top")))
    last = won.groupBy(*lvl, "received_ns").agg(F.max_by(F.struct("size", "seq"), "__k").alias("x"))
    return last.select(*lvl, "received_ns", "x.size", "x.seq")


def target_read_time(deltas: DataFrame, decisions: DataFrame, keys: Sequence[str] = ("symbol",), width: int = DAY_NS) -> DataFrame:
    """Origin time of the latest event observable at each decision."""
    ev = deltas.select(*keys, F.col("received_ns").alias("t"), F.lit(0).alias("kind"), F.col("origin_ns").alias("o"))
    dc = decisions.select(*keys, F.col("t_event").alias("t"), F.lit(1).alias("kind"))
    both = ev.unionByName(dc, allowMissingColumns=True).withColumn("__o", F.coalesce("o", F.lit(-1)))
    out = running(both, keys, ["t", "kind", "__o"], {"target_read_ts": ("max", F.col("o"))}, width=width)
    return out.filter("kind = 1").select(*keys, F.col("t").alias("t_event"), "target_read_ts")


def dual_book_reads(
    deltas: DataFrame,
    decisions: DataFrame,
    *,
    staleness_cap_ns: int,
    top_k: int = 1,
    keys: Sequence[str] = ("symbol",),
    width: int = DAY_NS,
) -> DataFrame:
    """Per decision: observable ladder, true label mid, and the first failure as ``role`` / ``reason``.

    Checked in order: observable top, staleness, label top. ``decisions`` needs unique ``t_event``.
    """
    keys = list(keys)
    d = decisions.select(*keys, "t_event")
    obs = book_asof(observable_deltas(deltas, keys, width), d, k=top_k, keys=keys, ts="received_ns", probe_ts="t_event", width=width)
    lab = book_asof(deltas, d, k=1, keys=keys, ts="origin_ns", probe_ts="t_event", width=width)
    lab = lab.select(
        *keys,
        "t_event",
        F.col("mid").alias("label_mid"),
        F.col("microprice").alias("label_microprice"),
        top_validity().alias("label_validity"),
    )
    read = target_read_time(deltas, d, keys, width)
    on = [*keys, "t_event"]
    out = obs.withColumn("obs_validity", top_validity()).join(lab, on).join(read, on)
    age = F.col("t_event") - F.col("target_read_ts")
    stale = F.coalesce(age > staleness_cap_ns, F.lit(False))
    bad_obs, bad_lab = F.col("obs_validity") != "ok", F.col("label_validity") != "ok"
    role = F.when(bad_obs | stale, "observable").when(bad_lab, "label")
    reason = F.when(bad_obs, F.col("obs_validity")).when(stale, "stale_book").when(bad_lab, F.col("label_validity"))
    return out.withColumns({"role": role, "reason": reason})


def bar_costs(taker_fee_bps: float, base_slippage_bps: float) -> dict[str, Column]:
    """Half spread, latency drift, slippage and round-trip cost in bps, from a surviving read."""
    mid, lab = F.col("mid"), F.col("label_mid")
    half = (F.col("ask_0_price") - F.col("bid_0_price")) * 0.5 / mid * 1e4
    drift = F.abs(lab / mid - 1.0) * 1e4
    slip = drift + base_slippage_bps
    return {
        "half_spread_bps": half,
        "latency_drift_bps": drift,
        "slippage_bps": slip,
        "cost_bps": slip + 2.0 * taker_fee_bps,
    }
