"""Book quality and vendor parity queries."""

from pyspark.sql import functions as F

from lobspark.operators import parity as P
from lobspark.operators import quality as Q
from lobspark.operators.ordered import asof, range_join
from lobspark.operators.stats import abs_stats
from lobspark.plans.common import r
from lobspark.plans.queries_book import LEVELS
from lobspark.plans.queries_sources import snapshots
from lobspark.plans.registry import query
from lobspark.plans.tables import FRAGMENTS, GRID_NS, Tables, sql

H = GRID_NS
CROSSED = "coalesce(bid_0_price>=ask_0_price,false)"
PRESENT = "(bid_0_price IS NOT NULL AND ask_0_price IS NOT NULL)"
VALID = f"({PRESENT} AND NOT {CROSSED})"


def rnd(df, *cols, d=6):
    return df.withColumns({c: r(c, d) for c in cols})


def days(df):
    return df.withColumn("dt", F.to_date(F.timestamp_micros(F.expr("sample_ts div 1000"))))


FRAGMENTS["topk_b_day"] = (("topk_b",), "SELECT *, cast(make_timestamp(sample_ts//1000) AS date) dt FROM topk_b")
FRAGMENTS["quality_v"] = (
    ("topk_b_day",),
    f"""SELECT symbol, dt, count(*) n_samples, count(*) FILTER (WHERE {CROSSED}) crossed_samples, round(avg({CROSSED}::INT),6)+0.0 crossed_rate,
      count(*) FILTER (WHERE NOT {PRESENT}) missing_book_samples, round(avg((NOT {PRESENT})::INT),6)+0.0 missing_book_fraction,
      count(*) FILTER (WHERE {VALID} AND least(bid_depth, ask_depth)<3) thin_depth_samples,
      round(avg(({VALID} AND least(bid_depth, ask_depth)<3)::INT),6)+0.0 thin_depth_fraction FROM topk_b_day GROUP BY 1,2""",
)


@query("frame_quality", sql("SELECT symbol, dt, n_samples, crossed_samples, crossed_rate, missing_book_samples, missing_book_fraction FROM quality_v", "quality_v"))
def frame_quality(t: Tables):
    q = Q.frame_quality(days(t.topk_b), ["symbol", "dt"], k=3).drop("thin_depth_samples", "thin_depth_fraction")
    return rnd(q, "crossed_rate", "missing_book_fraction")


@query("thin_depth_rate", sql("SELECT symbol, dt, thin_depth_samples, thin_depth_fraction FROM quality_v", "quality_v"))
def thin_depth_rate(t: Tables):
    q = Q.frame_quality(days(t.topk_b), ["symbol", "dt"], k=3)
    return rnd(q.select("symbol", "dt", "thin_depth_samples", "thin_depth_fraction"), "thin_depth_fraction")


FRAGMENTS["quotes_b_v"] = (
    ("deltas_v",),
    FRAGMENTS["quotes_v"][1].replace("deltas_clean_v", "deltas_v"),
)


@query(
    "crossed_duration",
    sql(
        """SELECT symbol, cast(sum(CASE WHEN best_bid>=best_ask THEN coalesce(n, greatest(e, ts))-ts ELSE 0 END) AS bigint) crossed_duration_ns FROM (
             SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) n, 1706659200000000000 e FROM quotes_b_v) GROUP BY 1""",
        "quotes_b_v",
    ),
)
def crossed_duration(t: Tables):
    return Q.crossed_duration(t.stored("quotes_b"), ["symbol"], F.lit(1_706_659_200_000_000_000))


@query("valid_mask", sql(f"SELECT symbol, sample_ts, {VALID} AND bid_depth>=2 AND ask_depth>=2 valid FROM topk_b", "topk_b"))
def valid_mask(t: Tables):
    return t.topk_b.select("symbol", "sample_ts", Q.valid(2).alias("valid"))


def runs_sql(flag: str, src: str, keys: str = "symbol") -> str:
    """Maximal runs where ``flag`` holds: keys, start_ts, end_ts, n."""
    return f"""SELECT {keys}, min(sample_ts) start_ts, max(sample_ts)+{H} end_ts, count(*) n FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY sample_ts) - row_number() OVER (PARTITION BY {keys}, {flag} ORDER BY sample_ts) g
      FROM {src}) WHERE {flag} GROUP BY {keys}, g"""


@query("invalid_runs", sql(runs_sql(f"(NOT {VALID})", "topk_b"), "topk_b"))
def invalid_runs(t: Tables):
    return Q.runs(t.stored("topk_b"), ["symbol"], ~Q.valid(), H)


@query(
    "invalid_run_samples",
    sql(
        f"""WITH runs AS ({runs_sql(f'(NOT {VALID})', 'topk_b')}) SELECT t.symbol, t.sample_ts, (t.sample_ts-r.start_ts)//{H} pos_in_run, r.n
            FROM topk_b t JOIN runs r ON r.symbol=t.symbol AND t.sample_ts>=r.start_ts AND t.sample_ts<r.end_ts""",
        "topk_b",
    ),
)
def invalid_run_samples(t: Tables):
    spans = Q.runs(t.stored("topk_b"), ["symbol"], ~Q.valid(), H).withColumn("last_ts", F.col("end_ts") - 1)
    pts = t.stored("topk_b").select("symbol", "sample_ts")
    j = range_join(pts, spans, ["symbol"], point_lo="sample_ts", point_hi="sample_ts", span_lo="start_ts", span_hi="last_ts", width=24 * H)
    return j.select("symbol", "sample_ts", F.expr(f"(sample_ts - start_ts) div {H}L").alias("pos_in_run"), "n")


@query(
    "warmup_cutoff",
    sql(f"SELECT symbol, min(start_ts+2*{H}) FILTER (WHERE n>=3) cutoff_ts FROM ({runs_sql(VALID, 'topk_b')}) GROUP BY 1", "topk_b"),
)
def warmup_cutoff(t: Tables):
    return Q.warmup_cutoff(t.stored("topk_b"), ["symbol"], H, 3)


SEED = 1_704_240_000_000_000_000  # 2024-01-03


@query(
    "warmup_qualified_ts",
    sql(f"SELECT symbol, min(start_ts+2*{H}) FILTER (WHERE n>=3) cutoff_ts FROM ({runs_sql(VALID, f'(SELECT * FROM topk_b WHERE sample_ts>={SEED})')}) GROUP BY 1", "topk_b"),
)
def warmup_qualified_ts(t: Tables):
    return Q.warmup_cutoff(t.stored("topk_b"), ["symbol"], H, 3, since=F.lit(SEED))


LV = ", ".join(LEVELS)


@query(
    "frozen_runs",
    sql(
        f"""WITH c AS (SELECT *, row({LV}) st, lag(row({LV})) OVER (PARTITION BY symbol ORDER BY sample_ts) p FROM topk_a),
          g AS (SELECT *, sum((p IS DISTINCT FROM st)::INT) OVER (PARTITION BY symbol ORDER BY sample_ts) i FROM c),
          q AS (SELECT symbol, i, count(*) n, count(*) FILTER (WHERE {VALID}) v FROM g GROUP BY 1,2)
          SELECT symbol, cast(sum(n) AS bigint) n_samples, count(*) FILTER (WHERE n>=3) n_frozen_runs, coalesce(max(n) FILTER (WHERE n>=3),0) max_frozen_run,
            round(coalesce(sum(n) FILTER (WHERE n>=3),0)/sum(n)::DOUBLE,6)+0.0 frozen_fraction,
            round(coalesce(sum(v) FILTER (WHERE n>=3),0)/sum(n)::DOUBLE,6)+0.0 stale_but_uncrossed_fraction FROM q GROUP BY 1""",
        "topk_a",
    ),
)
def frozen_runs(t: Tables):
    q = Q.frozen_metrics(t.stored("topk_a"), ["symbol"], LEVELS, H, min_run=3)
    return rnd(q, "frozen_fraction", "stale_but_uncrossed_fraction")


@query(
    "silence_metrics",
    sql(
        """SELECT symbol, count(*) n_events, round(max(g),3)+0.0 max_gap_s, count(*) FILTER (WHERE g>600) gaps_gt_600s, count(*) FILTER (WHERE g>3600) gaps_gt_3600s,
             round(coalesce(sum(g) FILTER (WHERE g>600),0),3)+0.0 silent_seconds_gt_600s FROM (
           SELECT symbol, (origin_ns-lag(origin_ns) OVER (PARTITION BY symbol ORDER BY origin_ns, seq))/1e9 g FROM deltas_v) GROUP BY 1""",
        "deltas_v",
    ),
)
def silence_metrics(t: Tables):
    q = Q.silence_metrics(t.deltas, ["symbol"], "origin_ns", "seq", bars_s=(600, 3600))
    return rnd(q, "max_gap_s", "silent_seconds_gt_600s", d=3)


@query(
    "sustained_cross_trigger",
    sql(
        f"""SELECT symbol, min(greatest(start_ts,{SEED})+{2 * H}) FILTER (WHERE end_ts-{H}>=greatest(start_ts,{SEED})+{2 * H}) trigger_ts
            FROM ({runs_sql(CROSSED, 'topk_b')}) WHERE greatest(start_ts,{SEED})+{2 * H} > {SEED} GROUP BY 1""",
        "topk_b",
    ),
)
def sustained_cross_trigger(t: Tables):
    return Q.sustained_cross_trigger(t.stored("topk_b"), ["symbol"], H, 2 * H, F.lit(SEED))


# ------------------------------------------------------------------ snapshot candidates
FRAGMENTS["snap_class_v"] = (
    ("snap_levels_v", "grid_v"),
    """SELECT g.symbol, g.dt, g.sample_ts, coalesce(nb,0) nb, coalesce(na,0) na, bb, ba,
         CASE WHEN coalesce(nb,0)=0 OR coalesce(na,0)=0 THEN 'one_sided' WHEN bad THEN 'bad_values' WHEN nb<3 OR na<3 THEN 'thin_depth'
              WHEN bb>=ba THEN 'crossed' WHEN (ba-bb)/((ba+bb)/2.0)>0.01 THEN 'wide_spread' ELSE 'ok' END reason
       FROM grid_v g LEFT JOIN (SELECT symbol, sample_ts, count(*) FILTER (WHERE side='bid') nb, count(*) FILTER (WHERE side='ask') na,
         max(tick) FILTER (WHERE side='bid') bb, min(tick) FILTER (WHERE side='ask') ba, bool_or(size<=0) bad FROM snap_levels_v GROUP BY 1,2) l USING (symbol, sample_ts)""",
)


@query("classify_snapshot", sql("SELECT symbol, sample_ts, reason FROM snap_class_v", "snap_class_v"))
def classify_snapshot(t: Tables):
    return snapshots(t).select("symbol", "sample_ts", Q.classify_snapshot(3, 0.01).alias("reason"))


@query(
    "classify_seed_candidate",
    sql(
        f"""SELECT symbol, sample_ts, CASE WHEN sample_ts>req THEN 'future' WHEN req-sample_ts>{5 * H} THEN 'stale' WHEN reason<>'ok' THEN reason ELSE 'ok' END reason
            FROM (SELECT *, epoch_us(cast(dt AS timestamp))*1000+{12 * H} req FROM snap_class_v)""",
        "snap_class_v",
    ),
)
def classify_seed_candidate(t: Tables):
    from lobspark.operators.book import day_open

    return snapshots(t).select(
        "symbol", "sample_ts", Q.classify_seed_candidate(day_open() + 12 * H, 5 * H, 100.0, 3, 0.01).alias("reason")
    )


REASONS = ("ok", "one_sided", "bad_values", "thin_depth", "unsorted", "crossed", "wide_spread")
FRAGMENTS["preclass_v"] = (
    ("snap_class_v",),
    "SELECT symbol, dt, count(*) n_candidates, "
    + ", ".join(f"count(*) FILTER (WHERE reason='{x}') n_{x}" for x in REASONS)
    + """, min(sample_ts) FILTER (WHERE reason='ok') seed_ts, round(avg((reason='crossed')::INT),6)+0.0 seed_source_crossed_frac,
       count(*) FILTER (WHERE reason='ok')>0 seed_accepted,
       CASE WHEN count(*) FILTER (WHERE reason='ok')>0 THEN 'ok' ELSE arg_min(reason, sample_ts) END seed_reason FROM snap_class_v GROUP BY 1,2""",
)


def preclassified(t: Tables):
    return rnd(Q.preclassify_snapshots(snapshots(t), ["symbol", "dt"], 3, 0.01), "seed_source_crossed_frac")


@query("preclassify_snapshots", sql("SELECT * FROM preclass_v", "preclass_v"))
def preclassify_snapshots(t: Tables):
    return preclassified(t)


LIMITS = Q.QualityThresholds(crossed_usable_max=0.5, missing_usable_max=0.02, thin_usable_max=0.3, seed_crossed_frac_max=0.15)
FRAGMENTS["day_metrics_v"] = (
    ("quality_v", "preclass_v"),
    """SELECT q.*, p.seed_accepted AND day(q.dt)%9<>0 seed_accepted, CASE WHEN day(q.dt)%9=0 THEN 'crossed' ELSE p.seed_reason END seed_reason,
         p.seed_source_crossed_frac, p.seed_ts, day(q.dt)%8<>0 have_book FROM quality_v q JOIN preclass_v p USING (symbol, dt)""",
)
OVER = """list_filter([CASE WHEN crossed_rate>0.5 THEN 'crossed_over_bar' END, CASE WHEN missing_book_fraction>0.02 THEN 'missing_over_bar' END,
  CASE WHEN thin_depth_fraction>0.3 THEN 'thin_depth_over_usable_bar' END], lambda x: x IS NOT NULL)"""
FRAGMENTS["day_class_v"] = (
    ("day_metrics_v",),
    f"""SELECT *, CASE WHEN NOT have_book THEN 'missing' WHEN NOT seed_accepted OR seed_source_crossed_frac>0.15 THEN 'inconclusive'
         WHEN len({OVER})>0 THEN 'degraded' ELSE 'usable' END classification,
       CASE WHEN NOT have_book THEN ['book_deltas_absent'] WHEN NOT seed_accepted THEN ['seed_rejected:'||seed_reason]
         WHEN seed_source_crossed_frac>0.15 THEN ['seed_accepted_but_source_unreliable'] ELSE list_concat(['seed_accepted'], {OVER}) END reasons FROM day_metrics_v""",
)


def day_metrics(t: Tables):
    q = rnd(Q.frame_quality(days(t.topk_b), ["symbol", "dt"], k=3), "crossed_rate", "missing_book_fraction", "thin_depth_fraction")
    p = preclassified(t).select("symbol", "dt", "seed_accepted", "seed_reason", "seed_source_crossed_frac", "seed_ts")
    d = F.dayofmonth("dt")
    return q.join(p, ["symbol", "dt"]).withColumns(
        {
            "have_book": d % 8 != 0,
            "seed_accepted": F.col("seed_accepted") & (d % 9 != 0),
            "seed_reason": F.when(d % 9 == 0, "crossed").otherwise(F.col("seed_reason")),
        }
    )


@query("classify_day_quality", sql("SELECT symbol, dt, classification, array_to_string(reasons, ',') reasons FROM day_class_v", "day_class_v"))
def classify_day_quality(t: Tables):
    c = Q.classify_day_quality(day_metrics(t), LIMITS)
    return c.select("symbol", "dt", "classification", F.array_join("reasons", ",").alias("reasons"))


@query(
    "classify_replay",
    sql(
        f"""SELECT symbol, dt, CASE WHEN NOT seed_accepted OR seed_source_crossed_frac>0.15 THEN 'inconclusive' WHEN len({OVER})>0 THEN 'degraded' ELSE 'certified' END classification,
              array_to_string(CASE WHEN NOT seed_accepted THEN ['seed_rejected:'||seed_reason] WHEN seed_source_crossed_frac>0.15 THEN ['seed_accepted_but_source_unreliable']
                ELSE list_concat(['seed_accepted'], {OVER}) END, ',') reasons FROM day_metrics_v""",
        "day_metrics_v",
    ),
)
def classify_replay(t: Tables):
    c = Q.classify_replay(day_metrics(t), LIMITS)
    return c.select("symbol", "dt", "classification", F.array_join("reasons", ",").alias("reasons"))


FRAGMENTS["fill_v"] = (
    ("day_class_v",),
    """SELECT *, CASE WHEN classification IN ('missing','degraded') OR (classification='inconclusive' AND list_contains(reasons,'seed_accepted_but_source_unreliable')) THEN true
         WHEN classification='usable' THEN false END needs_fill,
       CASE WHEN classification='missing' THEN 'book_deltas_absent' WHEN classification='degraded' THEN 'quality_over_usable_bar'
         WHEN classification='inconclusive' AND list_contains(reasons,'seed_accepted_but_source_unreliable') THEN 'crossed_seed_source'
         WHEN classification='usable' THEN 'usable' ELSE 'no_verdict' END why FROM day_class_v""",
)


@query("fill_decision", sql("SELECT symbol, dt, classification, needs_fill, why FROM fill_v", "fill_v"))
def fill_decision(t: Tables):
    c = Q.classify_day_quality(day_metrics(t), LIMITS).withColumns(Q.fill_decision())
    return c.select("symbol", "dt", "classification", "needs_fill", "why")


# ------------------------------------------------------------------ parity
FRAGMENTS["pair_v"] = (
    ("topk_a", "topk_b"),
    "SELECT a.symbol, a.sample_ts, "
    + ", ".join(f"{p}.{c} {p}_{c}" for p in ("a", "b") for c in ["mid", "microprice", "bid_depth", "ask_depth", *LEVELS])
    + " FROM topk_a a JOIN topk_b b USING (symbol, sample_ts)",
)


def pair(t: Tables):
    return P.align(t.topk_a, t.topk_b)


FRAC = ["a_missing_fraction", "b_missing_fraction", "either_missing_fraction", "a_crossed_rate", "b_crossed_rate", "signed_mean", "mid_corr"]


def compare_sql(src: str) -> str:
    top = lambda p: f"({p}_bid_0_price IS NOT NULL AND {p}_ask_0_price IS NOT NULL)"
    cr = lambda p: f"coalesce({p}_bid_0_price>={p}_ask_0_price,false)"
    both = f"({top('a')} AND {top('b')})"
    return f"""SELECT symbol, count(*) n_grid, count(*) FILTER (WHERE {both}) both_present, round(avg((NOT {top('a')})::INT),6)+0.0 a_missing_fraction,
      round(avg((NOT {top('b')})::INT),6)+0.0 b_missing_fraction, round(avg((NOT {both})::INT),6)+0.0 either_missing_fraction,
      round(avg({cr('a')}::INT),6)+0.0 a_crossed_rate, round(avg({cr('b')}::INT),6)+0.0 b_crossed_rate,
      round(avg(a_mid-b_mid) FILTER (WHERE {both}),6)+0.0 signed_mean, round(corr(a_mid,b_mid) FILTER (WHERE {both}),6)+0.0 mid_corr FROM {src} GROUP BY 1"""


@query("compare_topk", sql(compare_sql("pair_v"), "pair_v"))
def compare_topk(t: Tables):
    return rnd(P.compare_topk(pair(t)), *FRAC)


def stats_sql(metrics: dict[str, str], src: str, keys: str = "symbol", d: int = 4) -> str:
    one = " UNION ALL ".join(f"SELECT {keys}, '{n}' metric, {e} v FROM {src}" for n, e in metrics.items())
    q = lambda p: f"round(quantile_cont(v,{p}),{d})+0.0"
    return f"SELECT {keys}, metric, count(v) n, {q(0.5)} median, round(avg(v),{d})+0.0 mean, {q(0.95)} p95, {q(0.99)} p99, round(max(v),{d})+0.0 max FROM ({one}) GROUP BY {keys}, metric"


BOTH = "a_mid IS NOT NULL AND b_mid IS NOT NULL"
DIFFS = {
    "mid": f"CASE WHEN {BOTH} THEN abs(a_mid-b_mid) END",
    "mid_bps": f"CASE WHEN {BOTH} THEN abs(a_mid-b_mid)/((a_mid+b_mid)/2)*1e4 END",
    "best_bid": f"CASE WHEN {BOTH} THEN abs(a_bid_0_price-b_bid_0_price) END",
    "best_ask": f"CASE WHEN {BOTH} THEN abs(a_ask_0_price-b_ask_0_price) END",
    **{f"{s}_{i}_{f}": f"abs(a_{s}_{i}_{f}-b_{s}_{i}_{f})" for i in range(2) for s in ("bid", "ask") for f in ("price", "size")},
}
STAT = ["median", "mean", "p95", "p99", "max"]


@query("compare_topk_diffs", sql(stats_sql(DIFFS, "pair_v"), "pair_v"))
def compare_topk_diffs(t: Tables):
    return rnd(P.diff_stats(pair(t), k=2), *STAT, d=4)


@query("abs_stats", sql(stats_sql({"quantity": "quantity", "notional": "price*quantity"}, "trades_v"), "trades_v"))
def abs_stats_query(t: Tables):
    s = abs_stats(t.trades, ["symbol"], {"quantity": F.col("quantity"), "notional": F.col("price") * F.col("quantity")})
    return rnd(s, *STAT, d=4)


@query(
    "level_coverage",
    sql(
        " UNION ALL ".join(
            f"""SELECT symbol, '{s}' side, {i}::BIGINT level, count(*) FILTER (WHERE a_{s}_{i}_price IS NOT NULL AND b_{s}_{i}_price IS NOT NULL) both_present,
            count(*) FILTER (WHERE a_{s}_{i}_price IS NOT NULL AND b_{s}_{i}_price IS NULL) only_a, count(*) FILTER (WHERE a_{s}_{i}_price IS NULL AND b_{s}_{i}_price IS NOT NULL) only_b FROM pair_v GROUP BY 1"""
            for s in ("bid", "ask")
            for i in range(2)
        ),
        "pair_v",
    ),
)
def level_coverage(t: Tables):
    return P.level_coverage(pair(t), 2)


BARS = (0.005, 0.01, 0.02, 0.04)


@query(
    "spike_distribution",
    sql(
        " UNION ALL ".join(
            f"SELECT symbol, {b}::DOUBLE bar, count(*) FILTER (WHERE abs(a_mid-b_mid)>{b}) n_over, round(avg((abs(a_mid-b_mid)>{b})::INT),6)+0.0 fraction FROM pair_v WHERE a_mid-b_mid IS NOT NULL GROUP BY 1"
            for b in BARS
        ),
        "pair_v",
    ),
)
def spike_distribution(t: Tables):
    return rnd(P.spike_distribution(pair(t), bars=BARS), "fraction")


@query(
    "top_spikes",
    sql("SELECT symbol, sample_ts, round(a_mid,6)+0.0 a_mid, round(b_mid,6)+0.0 b_mid, round(abs(a_mid-b_mid),9)+0.0 abs_dmid FROM pair_v WHERE a_mid-b_mid IS NOT NULL ORDER BY round(abs(a_mid-b_mid),9) DESC, symbol, sample_ts LIMIT 25", "pair_v"),
)
def top_spikes(t: Tables):
    return rnd(P.top_spikes(pair(t), 25), "a_mid", "b_mid")


@query(
    "signed_labels",
    sql(
        f"""SELECT symbol, sample_ts, CASE WHEN f IS NULL THEN NULL WHEN abs(f)>1e-4*abs(mid) THEN cast(sign(f) AS bigint) ELSE 0 END lbl FROM (
              SELECT a.symbol, a.sample_ts, a.mid, b.mid-a.mid f FROM topk_a a LEFT JOIN topk_a b ON b.symbol=a.symbol AND b.sample_ts=a.sample_ts+{2 * H})""",
        "topk_a",
    ),
)
def signed_labels(t: Tables):
    x = P.with_forward(t.stored("topk_a").select("symbol", "sample_ts", "mid"), {"f": "mid"}, 2 * H)
    return x.select("symbol", "sample_ts", P.signed_label(F.col("f"), F.col("mid"), 1.0).alias("lbl"))


def agreement_sql(src: str, band: float = 0.5) -> str:
    out = []
    for tag, st in (("1h", 1), ("2h", 2), ("6h", 6)):
        out.append(
            f"""SELECT symbol, '{tag}' horizon, count(*) n, round(avg((la=lb)::INT),6)+0.0 agreement, count(*) FILTER (WHERE la=1 AND lb=1) both_up,
            count(*) FILTER (WHERE la=-1 AND lb=-1) both_down, count(*) FILTER (WHERE la=0 AND lb=0) both_flat, count(*) FILTER (WHERE la<>lb) disagree,
            CASE WHEN count(*)>2 AND stddev(fa)>0 AND stddev(fb)>0 THEN round(corr(fa,fb),6)+0.0 END fwd_return_corr FROM (
              SELECT symbol, fa, fb, CASE WHEN abs(fa)>{band}e-4*abs(am) THEN sign(fa) ELSE 0 END la, CASE WHEN abs(fb)>{band}e-4*abs(bm) THEN sign(fb) ELSE 0 END lb FROM (
                SELECT x.symbol, x.a_mid am, x.b_mid bm, y.a_mid-x.a_mid fa, y.b_mid-x.b_mid fb FROM {src} x JOIN {src} y ON y.symbol=x.symbol AND y.sample_ts=x.sample_ts+{st * H})
              WHERE fa IS NOT NULL AND fb IS NOT NULL) GROUP BY 1"""
        )
    return " UNION ALL ".join(out)


STEPS = {"1h": H, "2h": 2 * H, "6h": 6 * H}


@query("label_agreement", sql(agreement_sql("pair_v"), "pair_v"))
def label_agreement(t: Tables):
    from lobspark.session import materialize

    p = materialize(pair(t).select("symbol", "sample_ts", "a_mid", "b_mid"))
    return rnd(P.label_agreement(p, STEPS, band_bps=0.5), "agreement", "fwd_return_corr")


OK2 = "(a_bid_0_price<a_ask_0_price AND b_bid_0_price<b_ask_0_price)"
FRAGMENTS["ticks_v"] = (
    ("pair_v",),
    f"""SELECT p.symbol, n_samples, n_joint_valid, joint_valid_fraction, t.* EXCLUDE (symbol) FROM (
        SELECT symbol, count(*) n_samples, count(*) FILTER (WHERE {OK2}) n_joint_valid, round(avg(coalesce({OK2},false)::INT),6)+0.0 joint_valid_fraction FROM pair_v GROUP BY 1) p
      LEFT JOIN (SELECT symbol, round(avg((db=0 AND da=0)::INT),6)+0.0 touch_exact, round(avg((db<=1 AND da<=1)::INT),6)+0.0 touch_within_1,
        round(avg(sb),6)+0.0 shared_bid_levels, round(avg(sa),6)+0.0 shared_ask_levels,
        {', '.join(f"round(quantile_cont({c},{q}),6)+0.0 {n}_{p}" for n, c in (('bid','db'),('ask','da'),('mid','dm')) for p, q in (('p50',0.5),('p95',0.95),('p99',0.99),('max',1.0)))}
        FROM (SELECT symbol, abs(round(a_bid_0_price*100)-round(b_bid_0_price*100)) db, abs(round(a_ask_0_price*100)-round(b_ask_0_price*100)) da,
          abs((round(a_bid_0_price*100)+round(a_ask_0_price*100))/2-(round(b_bid_0_price*100)+round(b_ask_0_price*100))/2) dm,
          len(list_intersect(list_filter([a_bid_0_price,a_bid_1_price], lambda x: x IS NOT NULL), list_filter([b_bid_0_price,b_bid_1_price], lambda x: x IS NOT NULL))) sb,
          len(list_intersect(list_filter([a_ask_0_price,a_ask_1_price], lambda x: x IS NOT NULL), list_filter([b_ask_0_price,b_ask_1_price], lambda x: x IS NOT NULL))) sa
          FROM pair_v WHERE {OK2}) GROUP BY 1) t ON t.symbol=p.symbol""",
)
TICKQ = [f"{n}_{p}" for n in ("bid", "ask", "mid") for p in ("p50", "p95", "p99", "max")]


def ticks(t: Tables):
    return rnd(P.compare_ticks(pair(t), 2, 100.0), "joint_valid_fraction", "touch_exact", "touch_within_1", "shared_bid_levels", "shared_ask_levels", *TICKQ)


@query("compare_ticks", sql("SELECT * FROM ticks_v", "ticks_v"))
def compare_ticks(t: Tables):
    return ticks(t)


CRITERIA = [("joint_valid_fraction", ">=", 0.4), ("touch_within_1", ">=", 0.9), ("mid_p50", "<=", 1.0), ("mid_p99", "<=", 4.0), ("not_measured", "<=", 1.0)]


@query(
    "evaluate_thresholds",
    sql(
        " UNION ALL ".join(
            f"SELECT symbol, '{m}' metric, '{op}' op, {b}::DOUBLE bound, {m if m != 'not_measured' else 'NULL::DOUBLE'} AS value, coalesce({m if m != 'not_measured' else 'NULL::DOUBLE'} {op} {b}, false) ok FROM ticks_v"
            for m, op, b in CRITERIA
        ),
        "ticks_v",
    ),
)
def evaluate_thresholds(t: Tables):
    m = ticks(t)
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c, _, _ in CRITERIA[:-1]])
    long = m.select("symbol", F.explode(cells).alias("x")).select("symbol", "x.metric", "x.value")
    bars = t.spark.createDataFrame(CRITERIA, "metric string, op string, bound double")
    return P.evaluate_thresholds(long, bars)


CUT = f"(SELECT symbol, greatest(min(start_ts+2*{H}) FILTER (WHERE n>=3), {SEED}) cut FROM ({runs_sql(VALID, 'topk_b')}) GROUP BY 1)"
FRAGMENTS["parity_pair_v"] = (
    ("pair_v", "topk_b"),
    f"SELECT p.*, coalesce(b_bid_0_price>=b_ask_0_price,false) drop_it FROM pair_v p JOIN {CUT} c USING (symbol) WHERE p.sample_ts>=c.cut",
)


def parity_pair(t: Tables):
    """Grid pairs after the warm-up clamp, with residual crossed samples of b marked for exclusion."""
    cut = Q.warmup_cutoff(t.stored("topk_b"), ["symbol"], H, 3).withColumn("cut", F.greatest("cutoff_ts", F.lit(SEED)))
    p = P.align(t.stored("topk_a"), t.stored("topk_b")).join(cut.select("symbol", "cut"), "symbol")
    return p.filter(F.col("sample_ts") >= F.col("cut")).drop("cut").withColumn("drop_it", P.is_crossed("b"))


@query("parity_run", sql(compare_sql("(SELECT * FROM parity_pair_v WHERE NOT drop_it)"), "parity_pair_v"))
def parity_run(t: Tables):
    return rnd(P.compare_topk(parity_pair(t).filter(~F.col("drop_it"))), *FRAC)


@query(
    "parity_labels",
    sql(agreement_sql("(SELECT symbol, sample_ts, CASE WHEN NOT drop_it THEN a_mid END a_mid, CASE WHEN NOT drop_it THEN b_mid END b_mid FROM parity_pair_v)"), "parity_pair_v"),
)
def parity_labels(t: Tables):
    from lobspark.session import materialize

    p = materialize(P.mask_mids(parity_pair(t), F.col("drop_it")).select("symbol", "sample_ts", "a_mid", "b_mid"))
    return rnd(P.label_agreement(p, STEPS, band_bps=0.5), "agreement", "fwd_return_corr")


INJECT = f"(SELECT symbol, sample_ts inj FROM snap_class_v WHERE reason='ok' AND (sample_ts//{H})%29=0)"


@query(
    "guarded_parity",
    sql(
        compare_sql(f"(SELECT * FROM parity_pair_v p WHERE NOT drop_it AND NOT EXISTS (SELECT 1 FROM {INJECT} i WHERE i.symbol=p.symbol AND p.sample_ts BETWEEN i.inj AND i.inj+{3 * H}))"),
        "parity_pair_v",
        "snap_class_v",
    ),
)
def guarded_parity(t: Tables):
    ok = snapshots(t).withColumn("reason", Q.classify_snapshot(3, 0.01)).filter(f"reason = 'ok' AND (sample_ts div {H}L) % 29 = 0")
    spans = ok.select("symbol", F.col("sample_ts").alias("inj"), (F.col("sample_ts") + 3 * H).alias("inj_end"))
    p = parity_pair(t).filter(~F.col("drop_it"))
    hit = range_join(p.select("symbol", "sample_ts"), spans, ["symbol"], point_lo="sample_ts", point_hi="sample_ts", span_lo="inj", span_hi="inj_end", width=24 * H)
    kept = p.join(hit.select("symbol", "sample_ts").distinct(), ["symbol", "sample_ts"], "left_anti")
    return rnd(P.compare_topk(kept), *FRAC)


# ------------------------------------------------------------------ plain join kinds
@query(
    "asof_join",
    sql(
        "SELECT t.symbol, t.seq, t.origin_ns, d.seq delta_seq, d.origin_ns delta_ns, d.tick delta_tick FROM trades_v t ASOF LEFT JOIN deltas_v d ON d.symbol=t.symbol AND d.origin_ns<=t.origin_ns",
        "trades_v",
        "deltas_v",
    ),
)
def asof_join(t: Tables):
    return asof(
        t.trades.select("symbol", "seq", "origin_ns"), t.deltas, ["symbol"], left_ts="origin_ns", right_ts="origin_ns", right_order=["seq"],
        cols={"delta_seq": F.col("seq"), "delta_ns": F.col("origin_ns"), "delta_tick": F.col("tick")},
    )


@query(
    "range_interval_join",
    sql("SELECT t.symbol, t.seq, t.origin_ns, i.start_ns, i.end_ns FROM trades_v t JOIN invalid_v i ON i.symbol=t.symbol AND t.origin_ns>=i.start_ns AND t.origin_ns<i.end_ns", "trades_v", "invalid_v"),
)
def range_interval_join(t: Tables):
    from lobspark.operators import book as B

    spans = B.invalid_intervals(t.stored("quotes"), t.stored("opens")).drop("dt").withColumn("last_ns", F.col("end_ns") - 1)
    pts = t.trades.select("symbol", "seq", "origin_ns")
    return range_join(pts, spans, ["symbol"], point_lo="origin_ns", point_hi="origin_ns", span_lo="start_ns", span_hi="last_ns", width=6 * H).drop("last_ns")


@query("grid_equi_join", sql("SELECT symbol, sample_ts, round(abs(a_mid-b_mid),6)+0.0 abs_dmid FROM pair_v", "pair_v"))
def grid_equi_join(t: Tables):
    return pair(t).select("symbol", "sample_ts", r(F.abs(F.col("a_mid") - F.col("b_mid"))).alias("abs_dmid"))


HOURS = f"SELECT DISTINCT symbol, origin_ns//{H}*{H} sample_ts FROM trades_v"


def trade_hours(t: Tables):
    return t.trades.select("symbol", F.expr(f"(origin_ns div {H}L) * {H}L").alias("sample_ts")).distinct()


@query("anti_join", sql(f"SELECT symbol, dt, sample_ts FROM grid_v ANTI JOIN ({HOURS}) USING (symbol, sample_ts)", "grid_v", "trades_v"))
def anti_join(t: Tables):
    return t.grid.join(trade_hours(t), ["symbol", "sample_ts"], "left_anti").select("symbol", "dt", "sample_ts")


@query("semi_join", sql(f"SELECT symbol, dt, sample_ts FROM grid_v SEMI JOIN ({HOURS}) USING (symbol, sample_ts)", "grid_v", "trades_v"))
def semi_join(t: Tables):
    return t.grid.join(trade_hours(t), ["symbol", "sample_ts"], "left_semi").select("symbol", "dt", "sample_ts")


DIFF_COLS = ["bid_0_price", "ask_0_price", "bid_depth"]


@query(
    "full_outer_diff",
    sql(
        """SELECT symbol, sample_ts, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'missing_in_one_run'
             WHEN len(d)>0 THEN 'keys_differ:'||array_to_string(d, ',') ELSE 'equal' END diff FROM (
           SELECT symbol, sample_ts, a, b, list_filter([%s], lambda x: x IS NOT NULL) d
           FROM (SELECT *, 1 n FROM topk_a WHERE (sample_ts//3600000000000)%%5<>0) a FULL JOIN (SELECT *, 1 n FROM topk_b WHERE (sample_ts//3600000000000)%%7<>0) b USING (symbol, sample_ts))"""
        % ", ".join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in DIFF_COLS),
        "topk_a",
        "topk_b",
    ),
)
def full_outer_diff(t: Tables):
    a = t.topk_a.filter("(sample_ts div 3600000000000L) % 5 <> 0")
    b = t.topk_b.filter("(sample_ts div 3600000000000L) % 7 <> 0")
    return P.frame_diff(a, b, ["symbol", "sample_ts"], DIFF_COLS)


@query("cross_join", sql("SELECT symbol, seq, tag, origin_ns+ns window_end FROM trades_v, (VALUES ('30m',1800000000000),('1h',3600000000000),('4h',14400000000000)) h(tag, ns)", "trades_v"))
def cross_join(t: Tables):
    h = t.spark.createDataFrame([("30m", 1_800_000_000_000), ("1h", 3_600_000_000_000), ("4h", 14_400_000_000_000)], "tag string, ns bigint")
    return t.trades.crossJoin(F.broadcast(h)).select("symbol", "seq", "tag", (F.col("origin_ns") + F.col("ns")).alias("window_end"))


@query(
    "left_join_routing",
    sql(
        """SELECT d.symbol, d.dt, coalesce(n,0) n_trades, CASE WHEN day(d.dt)%10=0 THEN 'excluded' WHEN n IS NULL OR n<60 THEN 'fill' ELSE 'required' END route
           FROM days_v d LEFT JOIN (SELECT symbol, dt, count(*) n FROM trades_v GROUP BY 1,2) c USING (symbol, dt)""",
        "days_v",
        "trades_v",
    ),
)
def left_join_routing(t: Tables):
    c = t.trades.groupBy("symbol", "dt").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    route = F.when(F.dayofmonth("dt") % 10 == 0, "excluded").when(n < 60, "fill").otherwise("required")
    return t.days.join(c, ["symbol", "dt"], "left").select("symbol", "dt", n.alias("n_trades"), route.alias("route"))
