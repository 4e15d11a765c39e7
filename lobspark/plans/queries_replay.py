"""Seeded replay, the quality map built on it, and seed-source arms."""

from pyspark.sql import functions as F

from lobspark.operators import parity as P
from lobspark.operators import quality as Q
from lobspark.operators import reseed as R
from lobspark.operators import stitch as S
from lobspark.plans.common import r
from lobspark.plans.queries_parity import preclassified
from lobspark.plans.queries_sources import snapshots
from lobspark.plans.queries_stitch import POLICY
from lobspark.plans.registry import query
from lobspark.plans.tables import FRAGMENTS, GRID_NS, Tables, sql
from lobspark.session import HOUR_NS, materialize

H = GRID_NS
SEEDED = R.ReseedPolicy(min_levels=3, reseed_after_ns=2 * H, max_spread_frac=0.01)


def tagged(t: Tables):
    return materialize(R.book_replay_seeded(t.deltas, snapshots(t), t.grid, k=2, policy=SEEDED))


LADDER = "STRUCT(t BIGINT, z DOUBLE)[]"
FRAGMENTS["replay_events_v"] = (
    ("deltas_v", "grid_v", "snap_class_v", "snap_levels_v"),
    f"""SELECT *, row_number() OVER (PARTITION BY symbol, dt ORDER BY ts, kind, seq) n FROM (
          SELECT symbol, dt, origin_ns ts, 1 kind, seq, side, tick::BIGINT tick, size::DOUBLE size, NULL::VARCHAR reason, NULL::{LADDER} sb, NULL::{LADDER} sa FROM deltas_v
          UNION ALL SELECT g.symbol, g.dt, g.sample_ts, 2, 0, NULL, NULL, NULL, reason, coalesce(sb, []), coalesce(sa, []) FROM snap_class_v g LEFT JOIN (
            SELECT symbol, sample_ts, list({{'t': tick::BIGINT, 'z': size::DOUBLE}}) FILTER (WHERE side='bid') sb, list({{'t': tick::BIGINT, 'z': size::DOUBLE}}) FILTER (WHERE side='ask') sa FROM snap_levels_v GROUP BY 1,2) l USING (symbol, sample_ts)
          UNION ALL SELECT symbol, dt, sample_ts, 3, 0, NULL, NULL, NULL, NULL, NULL, NULL FROM grid_v)""",
)


def _side_sql(name: str) -> str:
    """A side after one event: replaced by a snapshot that is taken, or with one level set or removed."""
    other = f"list_filter({name}s, lambda q: q.t<>tick)"
    return f"CASE WHEN take THEN s{name[0]} WHEN kind=1 AND side='{name}' THEN CASE WHEN size>0 THEN list_append({other}, {{'t': tick, 'z': size}}) ELSE {other} END ELSE {name}s END {name}s"


#: One event after another: book, seed, since when it is crossed, and the counters.
FRAGMENTS["replay_v"] = (
    ("replay_events_v",),
    f"""SELECT * FROM (WITH RECURSIVE c(symbol, dt, n, ts, kind, seeded, seed_ts, since, dur, reseeds, blocked, why, bids, asks) AS (
          SELECT DISTINCT symbol, dt, 0::BIGINT, 0::BIGINT, 0, false, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 'no_snapshots', []::{LADDER}, []::{LADDER} FROM replay_events_v
          UNION ALL
          SELECT symbol, dt, n, ts, kind, seeded, seed_ts, CASE WHEN kind=3 OR NOT seeded THEN since WHEN x THEN coalesce(since, ts) END,
            dur + CASE WHEN kind<>3 AND seeded AND NOT x AND since IS NOT NULL THEN ts-since ELSE 0 END, reseeds, blocked, why, bids, asks
          FROM (SELECT *, len(bids)>0 AND len(asks)>0 AND coalesce(list_max(list_transform(bids, lambda q: q.t))>=list_min(list_transform(asks, lambda q: q.t)), false) x FROM (
            SELECT symbol, dt, n, ts, kind, since, dur, seeded OR take seeded, coalesce(seed_ts, CASE WHEN take THEN ts END) seed_ts, reseeds+(take AND seeded)::BIGINT reseeds,
              blocked+(due AND reason<>'ok')::BIGINT blocked, CASE WHEN kind=2 AND why='no_snapshots' THEN reason ELSE why END why, {_side_sql('bid')}, {_side_sql('ask')}
            FROM (SELECT *, coalesce(kind=2 AND reason='ok' AND (NOT seeded OR due), false) take FROM (
              SELECT e.symbol, e.dt, e.n, e.ts, e.kind, e.side, e.tick, e.size, e.reason, e.sb, e.sa, c.seeded, c.seed_ts, c.since, c.dur, c.reseeds, c.blocked, c.why, c.bids, c.asks,
                coalesce(e.kind=2 AND c.seeded AND c.since IS NOT NULL AND e.ts-c.since>={2 * H}, false) due
              FROM c JOIN replay_events_v e ON e.symbol=c.symbol AND e.dt=c.dt AND e.n=c.n+1)))))
        SELECT * FROM c WHERE n>0)""",
)
_BEST = ", ".join(f"{s}l[{i + 1}].t/100.0::DOUBLE {s}_{i}_price, {s}l[{i + 1}].z {s}_{i}_size" for s in ("bid", "ask") for i in range(2))
FRAGMENTS["replay_frame_v"] = (
    ("replay_v",),
    f"""SELECT *, (bid_0_price+ask_0_price)/2.0::DOUBLE mid, (ask_0_size*bid_0_price+bid_0_size*ask_0_price)/(bid_0_size+ask_0_size) microprice FROM (
          SELECT symbol, dt, ts sample_ts, len(bids) bid_depth, len(asks) ask_depth, {_BEST} FROM (SELECT *, list_sort(bids, 'DESC') bidl, list_sort(asks, 'ASC') askl FROM replay_v WHERE kind=3))""",
)
FRAGMENTS["replay_metrics_v"] = (
    ("replay_v",),
    """SELECT symbol, dt, seeded seed_accepted, seed_ts, CASE WHEN seeded THEN 'ok' ELSE why END seed_reason, reseeds reseed_count, blocked reseed_blocked,
         dur+CASE WHEN since IS NOT NULL AND ts>since THEN ts-since ELSE 0 END crossed_duration_ns FROM replay_v QUALIFY row_number() OVER (PARTITION BY symbol, dt ORDER BY n DESC)=1""",
)
FRAGMENTS["replay_quality_v"] = (("replay_frame_v",), FRAGMENTS["quality_v"][1].replace("topk_b_day", "replay_frame_v").replace("ask_depth)<3", "ask_depth)<2"))
REPLAYED = "symbol, dt, sample_ts, bid_depth::BIGINT bid_depth, ask_depth::BIGINT ask_depth, " + ", ".join(f"{s}_{i}_{f}" for s in ("bid", "ask") for i in range(2) for f in ("price", "size"))


@query("book_replay_seeded", sql(f"SELECT {REPLAYED}, round(mid,6)+0.0 mid, round(microprice,6)+0.0 microprice FROM replay_frame_v", "replay_frame_v"))
def book_replay_seeded(t: Tables):
    f = R.replay_frame(tagged(t))
    return f.withColumns({"mid": r("mid"), "microprice": r("microprice")})


@query("book_replay_in_buckets", sql(f"SELECT {REPLAYED}, round(mid,6)+0.0 mid, round(microprice,6)+0.0 microprice FROM replay_frame_v", "replay_frame_v"))
def book_replay_in_buckets(t: Tables):
    """The same replay with every symbol-day in four tasks."""
    f = R.replay_frame(R.book_replay_seeded(t.deltas, snapshots(t), t.grid, k=2, policy=SEEDED, width=6 * HOUR_NS))
    return f.withColumns({"mid": r("mid"), "microprice": r("microprice")})


def day_table(t: Tables, tg):
    keys = ["symbol", "dt"]
    f = R.replay_frame(tg)
    q = Q.frame_quality(f, keys, k=2)
    m = R.replay_metrics(tg, keys)
    p = preclassified(t).select(*keys, "seed_source_crossed_frac")
    return q.join(m, keys).join(p, keys).withColumn("have_book", F.lit(True))


@query(
    "replay_metrics",
    sql(
        """SELECT q.*, m.* EXCLUDE (symbol, dt), seed_source_crossed_frac, true have_book FROM replay_quality_v q JOIN replay_metrics_v m USING (symbol, dt)
           JOIN (SELECT symbol, dt, seed_source_crossed_frac FROM preclass_v) p USING (symbol, dt)""",
        "replay_quality_v",
        "replay_metrics_v",
        "preclass_v",
    ),
)
def replay_metrics(t: Tables):
    d = day_table(t, tagged(t))
    return d.withColumns({c: r(c) for c in ("crossed_rate", "missing_book_fraction", "thin_depth_fraction", "seed_source_crossed_frac")})


@query("quality_map")
def quality_map(t: Tables):
    """Replay → quality → class → fill decision → stitch plan, one row per symbol-day."""
    tg = tagged(t)
    d = Q.classify_day_quality(day_table(t, tg), Q.QualityThresholds(0.05, 0.05, 0.5, 0.2)).withColumns(Q.fill_decision())
    f = R.replay_frame(tg).withColumn("valid", Q.valid()).select("symbol", "dt", "sample_ts", "valid")
    seeds = d.select("symbol", "dt", "seed_ts", (F.col("seed_source_crossed_frac") <= 0.2).alias("trusted"))
    prof = S.plan_day_stitch(f.join(seeds, ["symbol", "dt"]), H, POLICY)
    prof = prof.groupBy("symbol", "dt").agg(F.first("fill_profile").alias("fill_profile"), F.count("*").alias("n_segments"))
    return d.join(prof, ["symbol", "dt"]).select(
        "symbol", "dt", "classification", F.array_join("reasons", ",").alias("reasons"), "needs_fill", "why", "fill_profile", "n_segments", "reseed_count"
    )


@query("seed_source_arms")
def seed_source_arms(t: Tables):
    """The same days under several snapshot sources: quality and parity per arm, arm as a key column."""
    keys = ["symbol", "dt", "arm"]
    arms = F.array(*[F.lit(a) for a in ("none", "own", "sparse")])
    d = t.deltas.withColumn("arm", F.explode(arms))
    g = t.grid.withColumn("arm", F.explode(arms))
    sn = snapshots(t)
    s = sn.withColumn("arm", F.lit("own")).unionByName(sn.filter(F.expr(f"(sample_ts div {H}L) % 4 = 1")).withColumn("arm", F.lit("sparse")))
    tg = materialize(R.book_replay_seeded(d, s, g, k=2, policy=SEEDED, keys=keys))
    f = R.replay_frame(tg)
    q = Q.frame_quality(f, ["symbol", "arm"], k=2)
    base = t.stored("topk_a")
    levels = [c for c in base.columns if c not in ("symbol", "sample_ts")]
    ref = base.withColumn("arm", F.explode(arms)).select("symbol", "arm", "sample_ts", *levels)
    pr = P.compare_topk(P.align(f.select("symbol", "arm", "sample_ts", *levels), ref, ["symbol", "arm"]), ["symbol", "arm"])
    m = R.replay_metrics(tg, keys).groupBy("symbol", "arm").agg(F.sum("reseed_count").alias("reseeds"), F.count_if("seed_accepted").alias("seeded_days"))
    out = q.join(pr.select("symbol", "arm", "both_present", "signed_mean", "mid_corr"), ["symbol", "arm"]).join(m, ["symbol", "arm"])
    return out.withColumns({c: r(c) for c in ("crossed_rate", "missing_book_fraction", "thin_depth_fraction", "signed_mean", "mid_corr")})
