"""Gap-fill planning, seam masks, fill manifests and coverage calendars."""

from pyspark.sql import functions as F

from lobspark.operators import calendars as C
from lobspark.operators import quality as Q
from lobspark.operators import stitch as S
from lobspark.plans.common import r
from lobspark.plans.queries_parity import VALID, days, preclassified
from lobspark.plans.registry import query
from lobspark.plans.tables import FRAGMENTS, GRID_NS, Tables, sql
from lobspark.session import materialize

H = GRID_NS
POLICY = S.SeamPolicy(seam_guard_ns=H, warmup_consecutive=2, fill_min_ns=3 * H, min_segment_ns=6 * H, span_invalid_max=0.05)
HOUR = f"((sample_ts//{H})%24)"
GAP = f"""(CASE day(dt)%5 WHEN 1 THEN {HOUR}<5 WHEN 2 THEN {HOUR}>=18 WHEN 3 THEN {HOUR} BETWEEN 9 AND 13 WHEN 4 THEN {HOUR}<4 OR {HOUR}>=20
  ELSE day(dt)%7=0 AND {HOUR}%4=1 END)"""
FRAGMENTS["samples_v"] = (
    ("topk_a", "preclass_v"),
    f"""SELECT t.symbol, t.dt, t.sample_ts, {VALID} AND NOT {GAP.replace('dt', 't.dt').replace('sample_ts', 't.sample_ts')} valid, p.seed_ts, p.seed_source_crossed_frac<=0.15 trusted
       FROM (SELECT *, cast(make_timestamp(sample_ts//1000) AS date) dt FROM topk_a) t JOIN (SELECT * REPLACE (CASE WHEN day(dt)=21 THEN NULL ELSE seed_ts END AS seed_ts) FROM preclass_v) p USING (symbol, dt)""",
)
D = "PARTITION BY symbol, dt"
FRAGMENTS["plan_v"] = (
    ("samples_v",),
    f"""WITH a AS (SELECT *, row_number() OVER w i, min(sample_ts) OVER ({D}) day_open, max(sample_ts) OVER ({D})+{H} day_end, coalesce(lag(valid) OVER w <> valid, true)::INT c1 FROM samples_v WINDOW w AS ({D} ORDER BY sample_ts)),
      b AS (SELECT *, sum(c1) OVER ({D} ORDER BY sample_ts) vrun FROM a),
      c AS (SELECT *, NOT valid AND count(*) OVER ({D}, vrun)*{H}>={3 * H} long_fill FROM b),
      d AS (SELECT *, coalesce(lag(long_fill) OVER ({D} ORDER BY sample_ts) <> long_fill, true)::INT c2, valid AND coalesce(sample_ts>=seed_ts,false) AND NOT long_fill good FROM c),
      e AS (SELECT *, sum(c2) OVER ({D} ORDER BY sample_ts) span FROM d),
      f AS (SELECT *, (coalesce(lag(good) OVER w <> good, true) OR coalesce(lag(span) OVER w <> span, true))::INT c3 FROM e WINDOW w AS ({D} ORDER BY sample_ts)),
      g AS (SELECT *, sum(c3) OVER ({D} ORDER BY sample_ts) grun FROM f),
      h AS (SELECT *, row_number() OVER ({D}, grun ORDER BY sample_ts) pos FROM g),
      k AS (SELECT *, min(CASE WHEN good AND pos>=2 THEN i END) OVER ({D}, span) q, max(i) OVER ({D}, span)+1 span_end FROM h),
      l AS (SELECT *, coalesce(i>=q AND (span_end-q)*{H}>={6 * H}, false) AND NOT long_fill prim FROM k),
      m AS (SELECT *, CASE WHEN seed_ts IS NULL THEN 'no_accepted_seed' WHEN NOT trusted THEN 'crossed_seed_source'
          WHEN sum(prim::INT) OVER ({D})=0 AND count(q) OVER ({D})>0 THEN 'trusted_span_too_short' WHEN sum(prim::INT) OVER ({D})=0 THEN 'never_warmup_qualified'
          WHEN sum((prim AND NOT valid)::INT) OVER ({D})/sum(prim::INT) OVER ({D})::DOUBLE > 0.05 THEN 'quality_over_trusted_span' END full_day_reason FROM l),
      n AS (SELECT * REPLACE (prim AND full_day_reason IS NULL AS prim) FROM m),
      o AS (SELECT *, coalesce(lag(prim) OVER ({D} ORDER BY sample_ts) <> prim, true)::INT c4 FROM n),
      p AS (SELECT *, sum(c4) OVER ({D} ORDER BY sample_ts) seg FROM o),
      s AS (SELECT symbol, dt, seg, min(sample_ts) start_ts, max(sample_ts)+{H} end_ts, bool_or(prim) prim, any_value(day_open) day_open, any_value(day_end) day_end, any_value(full_day_reason) full_day_reason FROM p GROUP BY 1,2,3),
      t AS (SELECT *, CASE WHEN prim THEN 'primary' WHEN full_day_reason IS NOT NULL OR end_ts-start_ts>={3 * H} THEN 'fill' ELSE 'excluded' END AS source,
          CASE WHEN prim THEN 'trusted_seeded_reconstruction' WHEN full_day_reason IS NOT NULL THEN full_day_reason WHEN end_ts-start_ts<{3 * H} THEN 'leading_warmup_excluded'
            WHEN start_ts=day_open THEN 'missing_leading_segment' WHEN end_ts=day_end THEN 'missing_trailing_segment' ELSE 'missing_internal_segment' END reason FROM s),
      u AS (SELECT *, coalesce(bool_or(source='fill' AND start_ts=day_open) OVER ({D}),false)::INT kl, coalesce(bool_or(source='fill' AND start_ts<>day_open AND end_ts=day_end) OVER ({D}),false)::INT kt,
          coalesce(bool_or(source='fill' AND start_ts<>day_open AND end_ts<>day_end) OVER ({D}),false)::INT ki FROM t)
      SELECT symbol, dt, start_ts, end_ts, source, reason, CASE WHEN full_day_reason IS NOT NULL THEN 'full_day_fill' WHEN kl+kt+ki=0 THEN 'primary_only' WHEN kl+kt+ki>1 THEN 'mixed_partial_fill'
         WHEN kl=1 THEN 'leading_partial_fill' WHEN kt=1 THEN 'trailing_partial_fill' ELSE 'internal_gap_fill' END fill_profile, full_day_reason, day_open, day_end FROM u""",
)
FRAGMENTS["seams_v"] = (
    ("plan_v",),
    f"SELECT symbol, dt, start_ts seam_ts, p prev_source, source FROM (SELECT *, lag(source) OVER ({D} ORDER BY start_ts) p FROM plan_v) WHERE p<>source",
)


def samples(t: Tables):
    hour = F.expr(f"(sample_ts div {H}L) % 24")
    d = F.dayofmonth("dt") % 5
    gap = (
        F.when(d == 1, hour < 5)
        .when(d == 2, hour >= 18)
        .when(d == 3, hour.between(9, 13))
        .when(d == 4, (hour < 4) | (hour >= 20))
        .otherwise((F.dayofmonth("dt") % 7 == 0) & (hour % 4 == 1))
    )
    pre = preclassified(t).select(
        "symbol", "dt", F.when(F.dayofmonth("dt") != 21, F.col("seed_ts")).alias("seed_ts"), (F.col("seed_source_crossed_frac") <= 0.15).alias("trusted")
    )
    x = days(t.topk_a).withColumn("valid", Q.valid() & ~gap).select("symbol", "dt", "sample_ts", "valid")
    return x.join(pre, ["symbol", "dt"])


def plan(t: Tables):
    return S.plan_day_stitch(samples(t), H, POLICY)


def stored_plan(t: Tables):
    return materialize(plan(t))


@query("plan_day_stitch", sql("SELECT * FROM plan_v", "plan_v"))
def plan_day_stitch(t: Tables):
    return plan(t)


@query(
    "full_day_plan",
    sql("SELECT symbol, dt, epoch_us(cast(dt AS timestamp))*1000 start_ts, epoch_us(cast(dt AS timestamp))*1000+86400000000000 end_ts, 'fill' AS source, 'book_deltas_absent' reason, 'full_day_fill' fill_profile FROM days_v", "days_v"),
)
def full_day_plan(t: Tables):
    return S.full_day_plan(t.days, F.lit("book_deltas_absent")).drop("full_day_reason", "day_open", "day_end")


@query("seams", sql("SELECT * FROM seams_v", "seams_v"))
def seams(t: Tables):
    return S.seams(plan(t))


@query("fill_profile", sql("SELECT fill_profile, full_day_reason, count(DISTINCT (symbol, dt)) n_days, count(*) n_segments FROM plan_v GROUP BY 1,2", "plan_v"))
def fill_profile(t: Tables):
    return plan(t).groupBy("fill_profile", "full_day_reason").agg(F.count_distinct("symbol", "dt").alias("n_days"), F.count("*").alias("n_segments"))


G = POLICY.seam_guard_ns


def mask_sql(lo: str, hi: str, name: str, neg: str = "") -> str:
    return f"""SELECT g.symbol, g.sample_ts, {neg} EXISTS (SELECT 1 FROM seams_v s WHERE s.symbol=g.symbol AND {lo}<s.seam_ts+{G} AND {hi}>=s.seam_ts-{G}) {name} FROM grid_v g"""


@query("seam_guard_mask", sql(mask_sql("g.sample_ts", "g.sample_ts", "in_guard"), "grid_v", "seams_v"))
def seam_guard_mask(t: Tables):
    m = S.guard_mask(t.grid.select("symbol", "sample_ts"), S.seams(stored_plan(t)), G, ["symbol"])
    return m.withColumnRenamed("touched", "in_guard")


@query("label_valid_mask", sql(mask_sql("g.sample_ts", f"g.sample_ts+{2 * H}", "ok", "NOT"), "grid_v", "seams_v"))
def label_valid_mask(t: Tables):
    m = S.guard_mask(t.grid.select("symbol", "sample_ts"), S.seams(stored_plan(t)), G, ["symbol"], ahead_ns=2 * H)
    return m.select("symbol", "sample_ts", (~F.col("touched")).alias("ok"))


@query("feature_valid_mask", sql(mask_sql(f"g.sample_ts-{3 * H}", "g.sample_ts", "ok", "NOT"), "grid_v", "seams_v"))
def feature_valid_mask(t: Tables):
    m = S.guard_mask(t.grid.select("symbol", "sample_ts"), S.seams(stored_plan(t)), G, ["symbol"], back_ns=3 * H)
    return m.select("symbol", "sample_ts", (~F.col("touched")).alias("ok"))


WIN = f"SELECT symbol, seq, origin_ns start_ts, origin_ns+{4 * H} end_ts FROM trades_v"


def windows(t: Tables):
    return t.trades.select("symbol", "seq", F.col("origin_ns").alias("start_ts"), (F.col("origin_ns") + 4 * H).alias("end_ts"))


@query("window_crosses_seam", sql(f"SELECT * FROM ({WIN}) w WHERE EXISTS (SELECT 1 FROM seams_v s WHERE s.symbol=w.symbol AND w.start_ts<s.seam_ts AND s.seam_ts<=w.end_ts)", "trades_v", "seams_v"))
def window_crosses_seam(t: Tables):
    return S.window_crosses_seam(windows(t), S.seams(stored_plan(t)), ["symbol"])


@query("vendor_source_at", sql("SELECT t.symbol, t.seq, t.origin_ns sample_ts, p.source FROM trades_v t JOIN plan_v p ON p.symbol=t.symbol AND t.origin_ns>=p.start_ts AND t.origin_ns<p.end_ts", "trades_v", "plan_v"))
def vendor_source_at(t: Tables):
    return S.source_at(t.trades.select("symbol", "seq", F.col("origin_ns").alias("sample_ts")), stored_plan(t), ["symbol"])


@query(
    "window_vendor_sources",
    sql(
        f"""WITH e AS (SELECT symbol, min(start_ts) o, max(end_ts) z FROM plan_v GROUP BY 1), w AS ({WIN})
            SELECT symbol, seq, start_ts, end_ts, string_agg(DISTINCT source, '+' ORDER BY source) sources FROM (
              SELECT w.*, p.source FROM w JOIN plan_v p ON p.symbol=w.symbol AND p.start_ts<=w.end_ts AND w.start_ts<p.end_ts
              UNION ALL SELECT w.*, 'uncovered' FROM w JOIN e USING (symbol) WHERE w.start_ts<o OR w.end_ts>=z) GROUP BY 1,2,3,4""",
        "trades_v",
        "plan_v",
    ),
)
def window_vendor_sources(t: Tables):
    return S.window_sources(windows(t), stored_plan(t), ["symbol"])


@query(
    "check_segments",
    sql(
        f"""SELECT symbol, dt, count(*) FILTER (WHERE end_ts<=start_ts) n_empty, count(*) FILTER (WHERE pe<>start_ts) n_not_contiguous,
             count(*) FILTER (WHERE source NOT IN ('primary','fill','excluded')) n_unknown_source, min(start_ts)<>any_value(day_open) OR max(end_ts)<>any_value(day_end) uncovered_edge
           FROM (SELECT *, lag(end_ts) OVER ({D} ORDER BY start_ts) pe FROM (SELECT * FROM plan_v WHERE NOT (day(dt)%6=0 AND start_ts=day_open AND end_ts<day_end))) GROUP BY 1,2""",
        "plan_v",
    ),
)
def check_segments(t: Tables):
    broken = plan(t).filter(~((F.dayofmonth("dt") % 6 == 0) & (F.col("start_ts") == F.col("day_open")) & (F.col("end_ts") < F.col("day_end"))))
    return S.check_segments(broken)


# ------------------------------------------------------------------ fill manifest
FRAGMENTS["daybase_v"] = (
    ("fill_v", "plan_v", "trades_v"),
    """SELECT f.symbol, f.dt, f.classification, f.needs_fill, f.why, p.fill_profile, p.full_day_reason, day(f.dt)%11=3 book_gap, day(f.dt)%6=1 trades_gap,
         CASE WHEN day(f.dt)%10=0 THEN 'calendar' END excluded_reason, n*0.01 book_gb, n*0.002 trade_gb,
         CASE WHEN day(f.dt)%2=0 THEN 'measured' ELSE 'estimated' END book_basis, CASE WHEN day(f.dt)%3=0 THEN 'measured' ELSE 'estimated' END trade_basis
       FROM fill_v f JOIN (SELECT DISTINCT symbol, dt, fill_profile, full_day_reason FROM plan_v) p USING (symbol, dt)
       JOIN (SELECT symbol, dt, count(*) n FROM trades_v GROUP BY 1,2) c USING (symbol, dt)""",
)
PART = "('leading_partial_fill','trailing_partial_fill','internal_gap_fill','mixed_partial_fill')"
FRAGMENTS["dayrec_v"] = (
    ("daybase_v",),
    f"""SELECT *, CASE WHEN bn AND nf AND book_gap THEN 'both' WHEN bn AND nf THEN 'quality_map' WHEN bn THEN 'calendar_gap' END book_source,
         CASE WHEN bn AND nf AND fill_profile IN {PART} THEN 'partial' WHEN bn THEN 'full_day' END book_kind, bn book_needed,
         excluded_reason IS NULL AND trades_gap trade_needed, excluded_reason IS NULL AND needs_fill IS NULL AND NOT book_gap unresolved
       FROM (SELECT *, coalesce(needs_fill,false) nf, excluded_reason IS NULL AND (coalesce(needs_fill,false) OR book_gap) bn FROM daybase_v)""",
)
FRAGMENTS["units_v"] = (
    ("dayrec_v",),
    """SELECT symbol, dt, 'book' product, book_kind kind, book_gb gb, book_basis gb_basis, book_gb*2.5 usd FROM dayrec_v WHERE book_needed
       UNION ALL SELECT symbol, dt, 'trades', 'full_day', trade_gb, trade_basis, trade_gb*1.25 FROM dayrec_v WHERE trade_needed""",
)


def day_records(t: Tables):
    from lobspark.plans.queries_parity import LIMITS, day_metrics

    cls = Q.classify_day_quality(day_metrics(t), LIMITS).withColumns(Q.fill_decision())
    prof = plan(t).select("symbol", "dt", "fill_profile", "full_day_reason").distinct()
    n = t.trades.groupBy("symbol", "dt").agg(F.count("*").alias("n"))
    d = F.dayofmonth("dt")
    x = cls.select("symbol", "dt", "classification", "needs_fill", "why").join(prof, ["symbol", "dt"]).join(n, ["symbol", "dt"])
    x = x.withColumns(
        {
            "book_gap": d % 11 == 3,
            "trades_gap": d % 6 == 1,
            "excluded_reason": F.when(d % 10 == 0, "calendar"),
            "book_gb": F.col("n") * 0.01,
            "trade_gb": F.col("n") * 0.002,
            "book_basis": F.when(d % 2 == 0, "measured").otherwise("estimated"),
            "trade_basis": F.when(d % 3 == 0, "measured").otherwise("estimated"),
        }
    )
    return S.fill_day_records(x.drop("n"))


REC = ["symbol", "dt", "classification", "needs_fill", "why", "fill_profile", "book_needed", "book_source", "book_kind", "trade_needed", "unresolved"]


@query("fill_day_records", sql(f"SELECT {', '.join(REC)} FROM dayrec_v", "dayrec_v"))
def fill_day_records(t: Tables):
    return day_records(t).select(*REC)


@query(
    "fill_block_rollup",
    sql("SELECT classification, fill_profile, full_day_reason, count(*) n_days, min(dt) first_day, max(dt) last_day, count(*) FILTER (WHERE needs_fill) n_needs_fill FROM dayrec_v GROUP BY 1,2,3", "dayrec_v"),
)
def fill_block_rollup(t: Tables):
    return S.fill_block_rollup(day_records(t))


@query(
    "batch_quality_rollup",
    sql(
        """SELECT symbol, classification, count(DISTINCT batch) n_batches, cast(sum(n_days) AS bigint) n_days, cast(sum(n_fill) AS bigint) n_fill FROM (
             SELECT symbol, classification, day(dt)//7 batch, count(*) n_days, count(*) FILTER (WHERE needs_fill) n_fill FROM dayrec_v GROUP BY 1,2,3) GROUP BY 1,2""",
        "dayrec_v",
    ),
)
def batch_quality_rollup(t: Tables):
    per = day_records(t).groupBy("symbol", "classification", F.expr("dayofmonth(dt) div 7").alias("batch")).agg(F.count("*").alias("n_days"), F.count_if("needs_fill").alias("n_fill"))
    return S.batch_rollup(per, ["symbol", "classification"], ["n_days", "n_fill"])


def units(t: Tables, window=None):
    rates = t.spark.createDataFrame([("book", 2.5), ("trades", 1.25)], "product string, usd_per_gb double")
    return S.fill_units(day_records(t), rates, window=window)


@query("fill_units", sql("SELECT symbol, dt, product, kind, round(gb,6)+0.0 gb, gb_basis, round(usd,6)+0.0 usd FROM units_v WHERE dt BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'", "units_v"))
def fill_units(t: Tables):
    u = units(t, (F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")))
    return u.withColumns({"gb": r("gb"), "usd": r("usd")})


GBS = ["book_gb_measured", "book_gb_estimated", "trades_gb_measured", "trades_gb_estimated", "gross_usd", "low_usd"]


@query(
    "fill_cost_summary",
    sql(
        """SELECT symbol, count(*) n_units, count(*) FILTER (WHERE product='book' AND kind='full_day') book_full_days, count(*) FILTER (WHERE product='book' AND kind='partial') book_partial_days,
             count(*) FILTER (WHERE product='trades') trade_units, """
        + ", ".join(f"round(coalesce(sum(gb) FILTER (WHERE product='{p}' AND gb_basis='{b}'),0),4)+0.0 {p}_gb_{b}" for p in ("book", "trades") for b in ("measured", "estimated"))
        + ", round(sum(usd),4)+0.0 gross_usd, round(coalesce(sum(usd) FILTER (WHERE gb_basis='measured'),0),4)+0.0 low_usd FROM units_v GROUP BY 1",
        "units_v",
    ),
)
def fill_cost_summary(t: Tables):
    return S.fill_cost_summary(units(t), ["symbol"]).withColumns({c: r(c, 4) for c in GBS})


@query(
    "addressability_buckets",
    sql(
        """SELECT bucket, count(*) AS days, round(sum(book_gb),4)+0.0 gb, count(*) FILTER (WHERE pilot) pilot_days, round(coalesce(sum(book_gb) FILTER (WHERE pilot),0),4)+0.0 pilot_gb FROM (
             SELECT *, dt BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' pilot, CASE WHEN classification='missing' OR book_gap THEN 'not_addressable_absent'
               WHEN full_day_reason='crossed_seed_source' THEN 'addressable_crossed_seed_source' WHEN unresolved THEN 'resolution_policy_days'
               WHEN book_kind='partial' THEN 'not_addressable_partial_fills' ELSE 'other_'||classification END bucket FROM dayrec_v WHERE book_needed) GROUP BY 1""",
        "dayrec_v",
    ),
)
def addressability_buckets(t: Tables):
    pilot = F.col("dt").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date"))
    a = S.addressability_buckets(day_records(t).filter("book_needed"), pilot)
    return a.withColumns({"gb": r("gb", 4), "pilot_gb": r("pilot_gb", 4)})


@query(
    "summary_reconciliation",
    sql(
        """SELECT name, a.n recomputed, b.n AS declared FROM (SELECT classification AS name, count(*) n FROM dayrec_v GROUP BY 1) a
           FULL JOIN (SELECT classification AS name, count(*) FILTER (WHERE symbol='S0')*2 n FROM dayrec_v GROUP BY 1 UNION ALL SELECT 'phantom', 3) b USING (name) WHERE a.n IS DISTINCT FROM b.n""",
        "dayrec_v",
    ),
)
def summary_reconciliation(t: Tables):
    d = materialize(day_records(t).select("symbol", F.col("classification").alias("name")))
    declared = d.groupBy("name").agg((F.count_if(F.col("symbol") == "S0") * 2).alias("n")).unionByName(t.spark.createDataFrame([("phantom", 3)], "name string, n bigint"))
    return S.summary_reconciliation(d.groupBy("name").agg(F.count("*").alias("n")), declared)


# ------------------------------------------------------------------ calendars over order dates
FRAGMENTS["presence_v"] = ((), "SELECT DISTINCT o_orderpriority feed, cast(o_orderdate AS date) dt FROM orders")
FRAGMENTS["fullcal_v"] = (
    ("presence_v",),
    "SELECT feed, dt FROM (SELECT DISTINCT feed FROM presence_v), (SELECT cast(unnest(generate_series(min(dt)::TIMESTAMP, max(dt)::TIMESTAMP, INTERVAL 1 DAY)) AS date) dt FROM presence_v)",
)


def presence(t: Tables):
    return C.presence_days(t.raw("orders").select("o_orderpriority", F.to_date("o_orderdate").alias("dt")), "o_orderpriority")


@query("presence_days", sql("SELECT * FROM presence_v", "presence_v"))
def presence_days(t: Tables):
    return presence(t)


@query("coverage_gaps", sql("SELECT feed, count(p.h) n_present, count(*) n_total, count(*)-count(p.h) n_missing FROM fullcal_v LEFT JOIN (SELECT *, 1 h FROM presence_v) p USING (feed, dt) GROUP BY 1", "fullcal_v"))
def coverage_gaps(t: Tables):
    return C.coverage_gaps(presence(t))


def day_runs_sql(src: str, keys: str, min_len: int) -> str:
    return f"""SELECT {keys}, min(dt) first_day, max(dt) last_day, count(*) n_days FROM (SELECT *, dt - cast(row_number() OVER (PARTITION BY {keys} ORDER BY dt) AS integer) g FROM ({src})) GROUP BY {keys}, g HAVING count(*)>={min_len}"""


@query("gap_runs", sql(day_runs_sql("SELECT * FROM fullcal_v ANTI JOIN presence_v USING (feed, dt)", "feed", 1), "fullcal_v"))
def gap_runs(t: Tables):
    return C.day_runs(C.missing_days(presence(t)), ["feed"])


@query("contiguous_runs", sql(day_runs_sql("SELECT * FROM presence_v", "feed", 3), "presence_v"))
def contiguous_runs(t: Tables):
    return C.day_runs(presence(t), ["feed"], 3)


REQUIRED = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
FILL = {"book": "4-NOT SPECIFIED", "trades": "5-LOW"}
FRAGMENTS["cal_v"] = (
    ("fullcal_v", "presence_v"),
    """SELECT dt, u usable, u AND b AND tr complete, u AND NOT b needs_book, u AND NOT tr needs_trades, array_to_string(list_filter(["""
    + ", ".join(f"CASE WHEN NOT r{i} THEN 'missing:{f}' END" for i, f in enumerate(REQUIRED))
    + "], lambda x: x IS NOT NULL), ',') excluded_reasons FROM (SELECT *, r0 AND r1 AND r2 u FROM (SELECT d.dt, "
    + ", ".join(f"coalesce(bool_or(p.feed='{f}'),false) r{i}" for i, f in enumerate(REQUIRED))
    + f", coalesce(bool_or(p.feed='{FILL['book']}'),false) b, coalesce(bool_or(p.feed='{FILL['trades']}'),false) tr FROM (SELECT DISTINCT dt FROM fullcal_v) d LEFT JOIN presence_v p USING (dt) GROUP BY 1))",
)


def calendar(t: Tables):
    p = presence(t)
    span = p.agg(F.min("dt").alias("lo"), F.max("dt").alias("hi"))
    wide = p.crossJoin(F.broadcast(span))  # one row
    return C.usable_calendar(wide, REQUIRED, FILL, F.col("lo"), F.col("hi"))


@query("usable_calendar", sql("SELECT * FROM cal_v", "cal_v"))
def usable_calendar(t: Tables):
    return calendar(t)


@query("oos_candidate_runs", sql(day_runs_sql("SELECT 'all' k, dt FROM cal_v WHERE usable", "k", 2), "cal_v"))
def oos_candidate_runs(t: Tables):
    return C.day_runs(calendar(t).filter("usable").select(F.lit("all").alias("k"), "dt"), ["k"], 2)


@query(
    "calendar_route",
    sql("SELECT o.feed venue, o.dt, CASE WHEN excluded_reasons<>'' THEN 'excluded' WHEN needs_trades THEN 'vendor_fill' ELSE 'required' END route, usable in_usable_days FROM presence_v o JOIN cal_v USING (dt)", "presence_v", "cal_v"),
)
def calendar_route(t: Tables):
    return C.calendar_route(presence(t).withColumnRenamed("feed", "venue"), calendar(t))


SEL = "SELECT dt FROM cal_v WHERE (complete OR (usable AND needs_trades AND NOT needs_book)) AND NOT needs_book AND excluded_reasons=''"


@query("batch_assign", sql(f"SELECT dt, (row_number() OVER (ORDER BY dt)-1)//7 batch FROM ({SEL})", "cal_v"))
def batch_assign(t: Tables):
    return C.batch_assign(C.calendar_select(calendar(t)), 7)


@query("calendar_select", sql(SEL, "cal_v"))
def calendar_select(t: Tables):
    return C.calendar_select(calendar(t))


SPANS = [("a", "1995-01-01", "1996-12-31"), ("b", "1997-01-01", "1998-12-31"), ("c", "1999-01-01", "2001-12-31")]


@query(
    "stratified_sample",
    sql(
        "WITH x AS (SELECT dt, min(span) span FROM cal_v JOIN (VALUES "
        + ", ".join(f"('{s}', DATE '{a}', DATE '{b}')" for s, a, b in SPANS)
        + ") s(span, lo, hi) ON dt BETWEEN lo AND hi WHERE usable AND day(dt)<>13 GROUP BY dt) SELECT dt, span, row_number() OVER (PARTITION BY span ORDER BY md5(dt::VARCHAR||'|7'), dt) AS depth FROM x QUALIFY true ORDER BY depth, span LIMIT 10",
        "cal_v",
    ),
)
def stratified_sample(t: Tables):
    c = calendar(t).filter("usable")
    spans = t.spark.createDataFrame(SPANS, "span string, lo string, hi string").select("span", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    return C.stratified_sample(c, spans, 10, 7, protected=c.filter("dayofmonth(dt) = 13"))
