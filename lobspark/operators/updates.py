"""ID-chained book updates: grouping into events, continuity verdicts, replay as a delta stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.operators.ordered import running, shift
from lobspark.session import materialize

ID_WIDTH = 1_000_000

# Verdicts that break a chain.
FAILING = ("conflicting_duplicate", "seed_anchor_gap", "incompatible_overlap", "sequence_gap", "ordering_anomaly", "backwards_snapshot")
APPLIED = ("snapshot", "anchor", "applied")
SKIPPED = ("pre_snapshot", "duplicate")


def group_update_events(rows: DataFrame) -> DataFrame:
    """Level rows to events after dropping identical rows, with the first contract breach as ``issue``.

    ``rows``: symbol, event_type, event_time, first_id, final_id, prev_id, last_id, side, tick, size.
    """
    r = rows.dropDuplicates()
    upd = F.col("event_type") == "update"
    r = r.withColumn("order_id", F.when(upd, F.col("final_id")).otherwise(F.col("last_id")))
    keys = ["symbol", "event_type", "order_id", "first_id", "final_id", "prev_id", "last_id"]
    n = F.count("*")
    ev = r.groupBy(*keys).agg(
        n.alias("n_levels"),
        F.count_distinct("side", "tick").alias("__lv"),
        F.min("event_time").alias("event_time"),
        F.max("event_time").alias("__hi"),
        F.count_if((F.col("tick") <= 0) | F.col("tick").isNull()).alias("__px"),
        F.count_if((F.col("size") < 0) | F.col("size").isNull()).alias("__sz"),
        F.bit_xor(F.xxhash64("side", "tick", "size")).alias("payload"),
    )
    issue = (
        F.when(upd & (F.col("first_id").isNull() | F.col("final_id").isNull()), "update_missing_ids")
        .when(upd & (F.col("first_id") > F.col("final_id")), "backwards_update_ids")
        .when(~upd & F.col("last_id").isNull(), "snapshot_missing_ids")
        .when(F.col("event_time") != F.col("__hi"), "event_time_not_uniform")
        .when(F.col("__px") > 0, "malformed_price")
        .when(F.col("__sz") > 0, "malformed_quantity")
        .when(F.col("n_levels") > F.col("__lv"), "duplicate_level_in_event")
    )
    ev = ev.withColumn("issue", issue).withColumn("kind", F.when(upd, 0).otherwise(1).cast("bigint"))
    return ev.drop("__lv", "__hi", "__px", "__sz")


def check_id_continuity(events: DataFrame, market: str, width: int = ID_WIDTH) -> DataFrame:
    """Verdict per event in ``(order_id, kind)`` order; a snapshot re-arms the anchor rule.

    Verdicts: snapshot, stale_snapshot, backwards_snapshot, pre_snapshot, duplicate, conflicting_duplicate, anchor,
    seed_anchor_gap, applied, incompatible_overlap, sequence_gap, ordering_anomaly. The watermark of an event is the latest
    event time of what was applied before it: a snapshot behind it is backwards, an update behind it that would be applied is an
    anomaly, and what is skipped anyway may regress (``regresses``). ``epoch`` is the id of the last accepted
    snapshot; ``chain_ok`` turns false at the first failing verdict and stays so until the next snapshot (the
    verdicts in between describe the chain as if it resumed).
    """
    if market not in ("futures", "spot"):
        raise ValueError("market must be futures or spot")
    order = ["order_id", "kind", "__f"]
    c = F.col
    x = events.withColumn("__f", F.coalesce("first_id", F.lit(0)))
    x = running(x, ["symbol"], order, {"snap": ("max", F.when(c("kind") == 1, c("last_id")))}, width=width, inclusive=False)
    cols = {"p_kind": c("kind"), "p_first": c("first_id"), "p_final": c("final_id"), "p_prev": c("prev_id"), "p_pay": c("payload")}
    x = shift(x, ["symbol"], order, cols, width=width)
    same = (c("p_kind") == 0) & (c("p_first") == c("first_id")) & (c("p_final") == c("final_id"))
    twin = same & c("p_prev").eqNullSafe(c("prev_id")) & (c("p_pay") == c("payload"))
    x = x.withColumn("twin", F.coalesce(twin, F.lit(False))).withColumn("clash", F.coalesce(same & ~twin, F.lit(False)))
    before = (c("final_id") < c("snap")) if market == "futures" else (c("final_id") <= c("snap"))
    live = (c("kind") == 0) & c("snap").isNotNull() & ~before & ~c("twin")
    x = x.withColumn("live", F.coalesce(live, F.lit(False)))
    x = running(x, ["symbol"], order, {"applied": ("last", F.when(c("live"), F.struct("final_id", "snap")))}, width=width, inclusive=False)
    anchored = F.coalesce(c("applied.snap") == c("snap"), F.lit(False))
    last = c("applied.final_id")
    if market == "futures":
        anchor_ok = ((c("first_id") <= c("snap")) & (c("snap") <= c("final_id"))) | F.coalesce(c("prev_id") == c("snap"), F.lit(False))
        chain_ok = F.coalesce(c("prev_id") == last, F.lit(False))
    else:
        anchor_ok = (c("first_id") <= c("snap") + 1) & (c("snap") + 1 <= c("final_id"))
        chain_ok = (c("first_id") == last + 1) & (c("prev_id").isNull() | (c("prev_id") == last))
    verdict = (
        F.when((c("kind") == 1) & F.coalesce(c("last_id") < F.greatest("snap", last), F.lit(False)), "stale_snapshot")
        .when(c("kind") == 1, "snapshot")
        .when(c("snap").isNull() | before, "pre_snapshot")
        .when(c("twin"), "duplicate")
        .when(c("clash"), "conflicting_duplicate")
        .when(~anchored & anchor_ok, "anchor")
        .when(~anchored, "seed_anchor_gap")
        .when(c("final_id") <= last, "incompatible_overlap")
        .when(chain_ok, "applied")
        .otherwise("sequence_gap")
    )
    x = x.withColumn("verdict", verdict)
    x = running(x, ["symbol"], order, {"__mark": ("max", F.when(c("verdict").isin(*APPLIED), c("event_time")))}, width=width, inclusive=False)
    x = x.withColumn("regresses", F.coalesce(c("event_time") < c("__mark"), F.lit(False)))
    behind = F.when(c("kind") == 1, "backwards_snapshot").when(c("verdict").isin("anchor", "applied"), "ordering_anomaly").otherwise(c("verdict"))
    x = x.withColumn("verdict", F.when(c("regresses"), behind).otherwise(c("verdict")))
    snapshot = c("verdict") == "snapshot"
    state = {"epoch": ("last", F.when(snapshot, c("order_id"))), "__broken": ("last", F.when(c("verdict").isin(*FAILING), True).when(snapshot, False))}
    x = running(x, ["symbol"], order, state, width=width)
    return x.select(*events.columns, "verdict", "epoch", (~F.coalesce("__broken", F.lit(False))).alias("chain_ok"), "regresses")


def chain_summary(checked: DataFrame, max_regression_frac: float = 0.001) -> DataFrame:
    """Counters of each symbol's replay up to its halt, and how it ended.

    A strict replay halts at the first failing verdict or stale snapshot (``halt`` and its ``halt_id``); the halting event is counted among the events
    only. Else ``halt`` is ``ordering_anomaly`` where skipped events regress too often, ``missing_initial_snapshot`` where none was applied, or null.
    """
    place = F.struct("order_id", "kind", F.coalesce("first_id", F.lit(0)).alias("f"))
    stops = F.when(F.col("verdict").isin(*FAILING, "stale_snapshot"), place)
    ends = checked.groupBy("symbol").agg(F.min(stops).alias("__stop"), F.min_by("verdict", stops).alias("__why"))
    x = checked.join(ends, "symbol")
    upto = F.col("__stop").isNull() | (place <= F.col("__stop"))
    before = F.col("__stop").isNull() | (place < F.col("__stop"))
    of = lambda *v: F.count_if(before & F.col("verdict").isin(*v))
    m = x.groupBy("symbol").agg(
        F.count_if(upto).alias("events"),
        of("snapshot").alias("snapshots_applied"),
        of("anchor", "applied").alias("updates_applied"),
        of("pre_snapshot").alias("updates_skipped_pre_snapshot"),
        of("duplicate").alias("duplicate_events_dropped"),
        F.count_if(before & F.col("verdict").isin(*SKIPPED) & F.col("regresses")).alias("event_time_regressions"),
        F.max("__stop.order_id").alias("halt_id"),
        F.max("__why").alias("__why"),
    )
    late = F.when(F.col("event_time_regressions") > max_regression_frac * F.col("events"), "ordering_anomaly")
    none = F.when(F.col("snapshots_applied") == 0, "missing_initial_snapshot")
    halt = F.coalesce(F.col("__why"), late, none)
    return m.withColumns({"resets": F.greatest(F.col("snapshots_applied") - 1, F.lit(0).cast("bigint")), "halt": halt}).drop("__why")


def replay_deltas(rows: DataFrame, checked: DataFrame) -> DataFrame:
    """Applied events as a level-2 delta stream; a snapshot, or the break of a chain, first removes the book's levels.

    The removals are the levels touched since the previous snapshot, so the stream feeds the ordinary
    book fold with no special reset case. Nothing is applied between a break and the next snapshot: the book is empty there.
    """
    event = ["symbol", "order_id", "kind", "event_time"]
    ok = checked.filter(F.col("verdict").isin("snapshot", "anchor", "applied") & F.col("chain_ok")).select(*event, "epoch").dropDuplicates(event)
    r = rows.dropDuplicates().withColumns(
        {"kind": F.when(F.col("event_type") == "update", 0).otherwise(1).cast("bigint"), "order_id": F.when(F.col("event_type") == "update", F.col("final_id")).otherwise(F.col("last_id"))}
    )
    lv = materialize(r.join(ok, event).select(*event, "side", "tick", "size", "epoch"))
    touched = lv.select("symbol", "epoch", "side", "tick").distinct()
    snaps = shift(ok.filter("kind = 1").drop("epoch"), ["symbol"], ["order_id"], {"epoch": F.col("order_id")}, width=ID_WIDTH).filter("epoch IS NOT NULL")
    first = F.min(F.struct("order_id", "kind", "event_time")).alias("at")
    breaks = checked.filter("NOT chain_ok AND epoch IS NOT NULL").groupBy("symbol", "epoch").agg(first).select("symbol", "epoch", "at.*")
    wipe = touched.join(snaps.unionByName(breaks), ["symbol", "epoch"]).select(*event, "side", "tick")
    wipe = wipe.join(lv, ["symbol", "order_id", "kind", "side", "tick"], "left_anti").withColumn("size", F.lit(0.0))
    out = lv.drop("epoch").unionByName(wipe)
    return out.select("symbol", F.col("event_time").alias("origin_ns"), (F.col("order_id") * 2 + F.col("kind")).alias("seq"), "side", "tick", "size")
