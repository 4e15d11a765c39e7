"""ID-chained updates derived from the delta view."""

from pyspark.sql import functions as F

from lobspark.operators import updates as U
from lobspark.operators.book import book_asof
from lobspark.plans.common import r
from lobspark.plans.registry import query
from lobspark.plans.tables import FRAGMENTS, Tables, sql
from lobspark.session import materialize

FRAGMENTS["upd_v"] = (
    ("deltas_v",),
    """SELECT symbol, CASE WHEN seq%500=3 THEN 'snapshot' ELSE 'update' END event_type, origin_ns event_time, CASE WHEN seq%500=3 THEN NULL ELSE seq*10+1 END first_id,
       CASE WHEN seq%500=3 THEN NULL ELSE seq*10+10 END final_id, CASE WHEN seq%500=3 THEN NULL WHEN seq%211=0 THEN 7 ELSE p*10+CASE WHEN p%500=3 THEN 10 ELSE 10 END END prev_id,
       CASE WHEN seq%500=3 THEN seq*10+10 END last_id, side, tick, size FROM (SELECT *, lag(seq) OVER (PARTITION BY symbol ORDER BY seq) p FROM deltas_v)""",
)


def rows(t: Tables):
    from lobspark.operators.ordered import shift

    d = shift(t.deltas, ["symbol"], ["origin_ns", "seq"], {"p": F.col("seq")})
    s = F.col("seq")
    snap = s % 500 == 3
    return d.select(
        "symbol", F.when(snap, "snapshot").otherwise("update").alias("event_type"), F.col("origin_ns").alias("event_time"),
        F.when(~snap, s * 10 + 1).alias("first_id"), F.when(~snap, s * 10 + 10).alias("final_id"),
        F.when(~snap, F.when(s % 211 == 0, 7).otherwise(F.col("p") * 10 + 10)).cast("bigint").alias("prev_id"),
        F.when(snap, s * 10 + 10).alias("last_id"), "side", "tick", "size",
    )


@query(
    "group_update_events",
    sql(
        """SELECT symbol, event_type, coalesce(final_id, last_id) order_id, count(*) n_levels, min(event_time) event_time,
             CASE WHEN event_type='update' AND first_id>final_id THEN 'backwards_update_ids' END issue FROM upd_v GROUP BY symbol, event_type, first_id, final_id, prev_id, last_id""",
        "upd_v",
    ),
)
def group_update_events(t: Tables):
    twice = rows(t).unionByName(rows(t).filter("final_id % 30 = 0"))
    return U.group_update_events(twice).select("symbol", "event_type", "order_id", "n_levels", "event_time", "issue")


@query(
    "check_id_continuity",
    sql(
        """WITH e AS (SELECT *, coalesce(final_id,last_id) oid FROM upd_v), s AS (SELECT *, max(last_id) OVER (PARTITION BY symbol ORDER BY oid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) snap FROM e),
             l AS (SELECT *, event_type='update' AND snap IS NOT NULL live FROM s), a AS (SELECT *, max(CASE WHEN live THEN final_id END) OVER w la, arg_max(CASE WHEN live THEN snap END, CASE WHEN live THEN oid END) OVER w ls FROM l WINDOW w AS (PARTITION BY symbol ORDER BY oid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
           SELECT verdict, count(*) n FROM (SELECT CASE WHEN event_type='snapshot' THEN 'snapshot' WHEN snap IS NULL THEN 'pre_snapshot'
             WHEN ls IS DISTINCT FROM snap THEN CASE WHEN (first_id<=snap AND snap<=final_id) OR coalesce(prev_id=snap,false) THEN 'anchor' ELSE 'seed_anchor_gap' END
             WHEN final_id<=la THEN 'incompatible_overlap' WHEN coalesce(prev_id=la,false) THEN 'applied' ELSE 'sequence_gap' END verdict FROM a) GROUP BY 1""",
        "upd_v",
    ),
)
def check_id_continuity(t: Tables):
    ev = materialize(U.group_update_events(rows(t)))
    return U.check_id_continuity(ev, "futures").groupBy("verdict").agg(F.count("*").alias("n"))


@query("replay_update_events")
def replay_update_events(t: Tables):
    rw = materialize(rows(t))
    checked = materialize(U.check_id_continuity(materialize(U.group_update_events(rw)), "futures"))
    d = materialize(U.replay_deltas(rw, checked))
    out = book_asof(d, t.grid, k=2)
    return out.withColumns({"mid": r("mid"), "microprice": r("microprice")})


BACK = 10_000_000_000_000
FRAGMENTS["uevents_v"] = (
    ("upd_v",),
    f"""SELECT symbol, oid, CASE event_type WHEN 'update' THEN 0 ELSE 1 END kind, event_time - CASE WHEN oid%3070=10 OR oid%15000=40 THEN {BACK} ELSE 0 END event_time, first_id, final_id, prev_id, last_id,
          row_number() OVER (PARTITION BY symbol ORDER BY oid, event_type DESC) n FROM (SELECT *, coalesce(final_id, last_id) oid FROM upd_v)""",
)
#: One event after another: the state is the last snapshot, what was applied, and the watermark.
FRAGMENTS["chain_v"] = (
    ("uevents_v",),
    """SELECT * FROM (WITH RECURSIVE c(symbol, n, oid, kind, base, mark_before, mark, event_time, snap, fin, fsnap) AS (
         SELECT symbol, 0::BIGINT, 0::BIGINT, 0, '', NULL::BIGINT, NULL::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM uevents_v GROUP BY symbol
         UNION ALL
         SELECT symbol, n, oid, kind, base, mark, CASE WHEN base IN ('snapshot', 'anchor', 'applied') THEN greatest(coalesce(mark, event_time), event_time) ELSE mark END, event_time,
           CASE WHEN kind=1 THEN greatest(coalesce(snap, last_id), last_id) ELSE snap END, CASE WHEN live THEN final_id ELSE fin END, CASE WHEN live THEN snap ELSE fsnap END
         FROM (SELECT *, kind=0 AND snap IS NOT NULL AND final_id>=snap live,
             CASE WHEN kind=1 THEN CASE WHEN last_id<coalesce(greatest(snap, fin), snap, fin, last_id) THEN 'stale_snapshot' ELSE 'snapshot' END
                  WHEN snap IS NULL OR final_id<snap THEN 'pre_snapshot'
                  WHEN fsnap IS DISTINCT FROM snap THEN CASE WHEN (first_id<=snap AND snap<=final_id) OR coalesce(prev_id=snap, false) THEN 'anchor' ELSE 'seed_anchor_gap' END
                  WHEN final_id<=fin THEN 'incompatible_overlap' WHEN coalesce(prev_id=fin, false) THEN 'applied' ELSE 'sequence_gap' END base
           FROM (SELECT e.symbol, e.n, e.oid, e.kind, e.event_time, e.first_id, e.final_id, e.prev_id, e.last_id, c.mark, c.snap, c.fin, c.fsnap FROM c JOIN uevents_v e ON e.symbol=c.symbol AND e.n=c.n+1)))
       SELECT symbol, n, oid, kind, coalesce(event_time<mark_before, false) regresses,
         CASE WHEN coalesce(event_time<mark_before, false) THEN CASE WHEN kind=1 THEN 'backwards_snapshot' WHEN base IN ('anchor','applied') THEN 'ordering_anomaly' ELSE base END ELSE base END verdict FROM c WHERE n>0)""",
)


def regressing(t: Tables):
    """The updates with some event times set back."""
    oid = F.coalesce("final_id", "last_id")
    back = F.when((oid % 3070 == 10) | (oid % 15000 == 40), BACK).otherwise(0)
    return U.check_id_continuity(materialize(U.group_update_events(rows(t).withColumn("event_time", F.col("event_time") - back))), "futures")


@query("chain_verdicts", sql("SELECT symbol, oid order_id, cast(kind AS bigint) kind, verdict, regresses FROM chain_v", "chain_v"))
def chain_verdicts(t: Tables):
    """Verdict of every single event, against a recursion over the events."""
    return regressing(t).select("symbol", "order_id", "kind", "verdict", "regresses")


@query(
    "chain_summary",
    sql(
        """WITH s AS (SELECT symbol, min(n) stop, arg_min(verdict, n) why, arg_min(oid, n) hid FROM chain_v WHERE verdict IN ('conflicting_duplicate','seed_anchor_gap','incompatible_overlap','sequence_gap','ordering_anomaly','backwards_snapshot','stale_snapshot') GROUP BY 1),
             m AS (SELECT symbol, any_value(why) why, any_value(hid) halt_id, count(*) FILTER (WHERE stop IS NULL OR n<=stop) events, count(*) FILTER (WHERE (stop IS NULL OR n<stop) AND verdict='snapshot') snapshots_applied,
               count(*) FILTER (WHERE (stop IS NULL OR n<stop) AND verdict IN ('anchor','applied')) updates_applied, count(*) FILTER (WHERE (stop IS NULL OR n<stop) AND verdict='pre_snapshot') updates_skipped_pre_snapshot,
               count(*) FILTER (WHERE (stop IS NULL OR n<stop) AND verdict='duplicate') duplicate_events_dropped, count(*) FILTER (WHERE (stop IS NULL OR n<stop) AND verdict IN ('pre_snapshot','duplicate') AND regresses) event_time_regressions
               FROM chain_v LEFT JOIN s USING (symbol) GROUP BY symbol)
           SELECT symbol, events, snapshots_applied, updates_applied, updates_skipped_pre_snapshot, duplicate_events_dropped, event_time_regressions, halt_id, greatest(snapshots_applied-1, 0) resets,
             coalesce(why, CASE WHEN event_time_regressions>0.001*events THEN 'ordering_anomaly' END, CASE WHEN snapshots_applied=0 THEN 'missing_initial_snapshot' END) halt FROM m""",
        "chain_v",
    ),
)
def chain_summary(t: Tables):
    return U.chain_summary(materialize(regressing(t)))
