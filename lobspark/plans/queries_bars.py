"""Bars, dual reads, features, labels and the model matrix."""

from pyspark.sql import functions as F

from lobspark.operators import bars as B
from lobspark.operators import labels as L
from lobspark.operators import matrix as M
from lobspark.operators.features import FEATURE_COLS
from lobspark.operators.reads import dual_book_reads, observable_deltas
from lobspark.plans.common import r
from lobspark.plans.queries_book import LEVELS
from lobspark.plans.registry import query
from lobspark.plans.tables import FRAGMENTS, Tables, sql, topk_fragment
from lobspark.session import DAY_NS, HOUR_NS, materialize
from lobspark.sources.publish import StageChecks

H = HOUR_NS
DAY0 = 1_704_067_200_000_000_000  # 2024-01-01
PARAMS = M.MatrixParams(
    horizons={"30m": H // 2, "1h": H, "4h": 4 * H},
    time_cap_ns=2 * H,
    window_days=7,
    warmup_days=2,
    target_bars=12,
    seed_threshold=27_000.0,
    staleness_cap_ns=H,
    top_k=2,
    tick_size=0.01,
    taker_fee_bps=1.0,
    base_slippage_bps=0.25,
    lookback_cap_ns=5 * H,
    guard_ns=4 * H,
    partition_start_ns=DAY0,
    partition_end_ns=DAY0 + 28 * DAY_NS,
    halflife_ns=6 * H,
    min_returns=5,
    width_mult=1.0,
    vol_floor_bps=0.5,
    regime_boundary_ticks=3.0,
)
P = PARAMS


def rnd(df, *cols, d=6):
    return df.withColumns({c: r(c, d) for c in cols})


# ------------------------------------------------------------------ the same steps in SQL
OPEN = "epoch_us(cast(dt AS timestamp))*1000"
FRAGMENTS["mdays_v"] = (("days_v",), "SELECT symbol, dt FROM days_v WHERE day(dt)<>15")
FRAGMENTS["sched_v"] = (
    ("mdays_v", "trades_v"),
    """SELECT symbol, dt, CASE WHEN n<2 THEN 27000.0::DOUBLE ELSE a/12 END threshold, n<2 is_warmup FROM (
         SELECT symbol, dt, count(*) OVER w n, avg(notional) OVER w a FROM (
           SELECT symbol, dt, coalesce(sum(price*quantity),0) notional FROM mdays_v LEFT JOIN trades_v USING (symbol, dt) GROUP BY 1,2)
         WINDOW w AS (PARTITION BY symbol ORDER BY dt RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING))""",
)
FRAGMENTS["bt_v"] = (
    ("trades_v", "mdays_v"),
    "SELECT *, row_number() OVER (PARTITION BY symbol, dt ORDER BY origin_ns, seq) rn FROM trades_v SEMI JOIN mdays_v USING (symbol, dt)",
)
CAP = P.time_cap_ns
FRAGMENTS["clock_v"] = (
    ("sched_v", "bt_v"),
    f"""/*rec*/ SELECT symbol, dt, threshold, is_warmup, 0::BIGINT rn, {OPEN} st, 0.0::DOUBLE acc, 0::BIGINT idx, 0::BIGINT mem,
          0::BIGINT c, {OPEN} st0, 0.0::DOUBLE acc0, 0::BIGINT idx0, false crossed, {OPEN} st2, 0.0::DOUBLE acc2, 0::BIGINT tbar, 0::BIGINT seq FROM sched_v
        UNION ALL
        SELECT symbol, dt, threshold, is_warmup, rn, CASE WHEN crossed THEN ts ELSE st2 END, CASE WHEN crossed THEN 0 ELSE acc2 END, tbar + crossed::BIGINT,
          CASE WHEN crossed THEN 0 WHEN c>0 THEN 1 ELSE mem0+1 END, c, st0, acc0, idx0, crossed, st2, acc2, tbar, seq FROM (
          SELECT *, acc2>=threshold crossed FROM (
          SELECT s.symbol, s.dt, s.threshold, s.is_warmup, t.rn, t.seq, t.origin_ns ts, s.st st0, s.acc acc0, s.idx idx0, s.mem mem0,
            greatest((t.origin_ns-s.st)//{CAP},0) c, s.st+greatest((t.origin_ns-s.st)//{CAP},0)*{CAP} st2,
            CASE WHEN t.origin_ns>=s.st+{CAP} THEN 0 ELSE s.acc END + t.price*t.quantity acc2, s.idx+greatest((t.origin_ns-s.st)//{CAP},0) tbar
          FROM clock_v s JOIN bt_v t ON t.symbol=s.symbol AND t.dt=s.dt AND t.rn=s.rn+1))""",
)
FRAGMENTS["bar_close_v"] = (
    ("clock_v",),
    f"""WITH l AS (SELECT *, greatest(({OPEN}+{DAY_NS}-st)//{CAP},0) cf FROM clock_v QUALIFY row_number() OVER (PARTITION BY symbol, dt ORDER BY rn DESC)=1)
      SELECT symbol, dt, threshold, is_warmup, idx0+j bar_idx, st0+j*{CAP} interval_start, 'time_cap' close_reason, st0+(j+1)*{CAP} cap_fire, CASE WHEN j=0 THEN acc0 ELSE 0 END notional
        FROM (SELECT *, unnest(range(c)) j FROM clock_v WHERE c>0)
      UNION ALL SELECT symbol, dt, threshold, is_warmup, tbar, st2, 'threshold', NULL, acc2 FROM clock_v WHERE crossed
      UNION ALL SELECT symbol, dt, threshold, is_warmup, idx+j, st+j*{CAP}, 'time_cap', st+(j+1)*{CAP}, CASE WHEN j=0 THEN acc ELSE 0 END FROM (SELECT *, unnest(range(cf)) j FROM l WHERE cf>0)
      UNION ALL SELECT symbol, dt, threshold, is_warmup, idx, st, 'day_end', {OPEN}+{DAY_NS}, acc FROM l WHERE cf=0 AND mem>0""",
)
FRAGMENTS["bars_v"] = (
    ("bar_close_v", "clock_v", "bt_v"),
    """SELECT b.*, count(m.seq) n_trades, max(received_ns) max_received, max(origin_ns) last_origin, count(*) FILTER (WHERE side='buy') n_buy,
         sum(CASE side WHEN 'buy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END*price*quantity) signed_notional, sum(CASE side WHEN 'buy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END*quantity) signed_amount,
         sum(quantity) total_amount, sum(price*quantity) total_notional, max(price*quantity) largest_notional, sum(pow(ln(price/pp)*1e4,2)) rv,
         min(price) low, max(price) high, arg_min(price, rn) open_price, arg_max(price, rn) close_price
       FROM bar_close_v b LEFT JOIN (SELECT t.*, c.tbar bar_idx, lag(t.price) OVER (PARTITION BY t.symbol, t.dt, c.tbar ORDER BY t.rn) pp
         FROM bt_v t JOIN clock_v c USING (symbol, dt, rn)) m USING (symbol, dt, bar_idx) GROUP BY ALL""",
)
FRAGMENTS["water_v"] = (
    ("bars_v",),
    f"""SELECT *, {OPEN} open_ns, coalesce(cap_fire, last_origin) close_ns,
         max(greatest(coalesce(max_received,0), coalesce(cap_fire,0))) OVER (PARTITION BY symbol ORDER BY dt, bar_idx) t_event FROM bars_v""",
)
FRAGMENTS["decisions_v"] = (
    ("water_v",),
    "SELECT * FROM water_v QUALIFY row_number() OVER (PARTITION BY symbol, t_event ORDER BY dt DESC, bar_idx DESC)=1",
)
FRAGMENTS["dprobe_v"] = (("decisions_v",), "SELECT symbol, t_event, t_event sample_ts FROM decisions_v")
OBS_LEVELS = """SELECT p.symbol, p.t_event, d.side, d.tick, arg_max(d.size, row(d.origin_ns, d.seq)) size
  FROM dprobe_v p JOIN deltas_clean_v d ON d.symbol=p.symbol AND d.received_ns<=p.t_event GROUP BY 1,2,3,4"""
FRAGMENTS["obs_v"] = (
    ("dprobe_v", "deltas_clean_v"),
    "SELECT *, (bid_0_price+ask_0_price)/2.0::DOUBLE mid, (ask_0_size*bid_0_price+bid_0_size*ask_0_price)/(bid_0_size+ask_0_size) microprice FROM ("
    "SELECT p.symbol, p.t_event, "
    + ", ".join(f"count(*) FILTER (WHERE l.side='{s}') {s}_depth" for s in ("bid", "ask"))
    + ", "
    + ", ".join(
        f"max({e}) FILTER (WHERE l.side='{s}' AND l.rn={i + 1}) {s}_{i}_{f}"
        for s in ("bid", "ask")
        for i in range(2)
        for f, e in (("price", "l.tick/100.0::DOUBLE"), ("size", "l.size"))
    )
    + f""" FROM dprobe_v p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol, t_event, side ORDER BY CASE side WHEN 'bid' THEN -tick ELSE tick END) rn
       FROM ({OBS_LEVELS}) WHERE size>0) l USING (symbol, t_event) GROUP BY 1,2)""",
)
FRAGMENTS["lab_v"] = (("dprobe_v", "deltas_clean_v"), topk_fragment("deltas_clean_v", grid="dprobe_v", ts="t_event", k=1))


def validity(b: str, a: str) -> str:
    return f"CASE WHEN {b} IS NULL AND {a} IS NULL THEN 'missing_book' WHEN {b} IS NULL OR {a} IS NULL THEN 'one_sided_book' WHEN {b}>={a} THEN 'crossed_book' ELSE 'ok' END"


FRAGMENTS["reads_v"] = (
    ("obs_v", "lab_v"),
    f"""SELECT *, CASE WHEN ov<>'ok' OR stale THEN 'observable' WHEN lv<>'ok' THEN 'label' END AS role,
         CASE WHEN ov<>'ok' THEN ov WHEN stale THEN 'stale_book' WHEN lv<>'ok' THEN lv END reason FROM (
       SELECT o.*, l.mid label_mid, l.microprice label_microprice, tr.target_read_ts, {validity('o.bid_0_price','o.ask_0_price')} ov, {validity('l.bid_0_price','l.ask_0_price')} lv,
         coalesce(o.t_event-tr.target_read_ts>{P.staleness_cap_ns}, false) stale
       FROM obs_v o JOIN lab_v l USING (symbol, t_event) LEFT JOIN (SELECT p.symbol, p.t_event, max(d.origin_ns) target_read_ts FROM dprobe_v p
         JOIN deltas_clean_v d ON d.symbol=p.symbol AND d.received_ns<=p.t_event GROUP BY 1,2) tr USING (symbol, t_event))""",
)
FRAGMENTS["seg_v"] = (
    ("mdays_v",),
    f"""SELECT symbol, dt, min(dt) OVER w seg, epoch_us(cast(min(dt) OVER w AS timestamp))*1000 seg_start_ns, epoch_us(cast(max(dt) OVER w AS timestamp))*1000+{DAY_NS} seg_end_ns
       FROM (SELECT *, dt - cast(row_number() OVER (PARTITION BY symbol ORDER BY dt) AS integer) g FROM mdays_v) WINDOW w AS (PARTITION BY symbol, g)""",
)
FRAGMENTS["dec_v"] = (
    ("decisions_v", "reads_v", "seg_v"),
    f"""SELECT d.*, r.* EXCLUDE (symbol, t_event), s.seg, s.seg_start_ns, s.seg_end_ns,
         (close_reason='day_end' OR d.t_event >= open_ns+{DAY_NS}) day_end_like FROM decisions_v d JOIN reads_v r USING (symbol, t_event) JOIN seg_v s USING (symbol, dt)""",
)
PREV = [*LEVELS, "bid_depth", "ask_depth", "target_read_ts"]


def flow_sql(side: str) -> str:
    gt, lt = (">", "<") if side == "bid" else ("<", ">")
    return "(" + "+".join(
        f"CASE WHEN {side}_{i}_price {gt} prev_{side}_{i}_price THEN {side}_{i}_size WHEN {side}_{i}_price {lt} prev_{side}_{i}_price THEN -prev_{side}_{i}_size ELSE {side}_{i}_size-prev_{side}_{i}_size END"
        for i in range(2)
    ) + ")"


FRAGMENTS["feat_v"] = (
    ("dec_v",),
    f"""SELECT *, ({flow_sql('bid')}-{flow_sql('ask')})*mid/threshold ofi_integrated, (microprice-mid)/mid*1e4 microprice_dev,
         (bid_0_size-ask_0_size)/(bid_0_size+ask_0_size) queue_imb, (ask_0_price-bid_0_price)/0.01::DOUBLE spread_tick, bd, ad,
         (bd-ad)/(bd+ad) depth_imbalance, (bd+ad)*mid/threshold/((ask_1_price-bid_1_price)/mid*1e4) book_slope,
         CASE WHEN n_trades>0 THEN signed_notional/threshold ELSE 0 END cvd, CASE WHEN n_trades>0 THEN signed_amount/total_amount ELSE 0 END signed_vol,
         CASE WHEN n_trades>0 THEN (2*n_buy-n_trades)/n_trades::DOUBLE ELSE 0 END aggressor_imb, CASE WHEN n_trades>0 THEN largest_notional/threshold ELSE 0 END largest_print,
         n_trades::DOUBLE trade_count, CASE WHEN n_trades>0 THEN (total_notional/total_amount-mid)/mid*1e4 ELSE 0 END vwap_minus_mid,
         CASE WHEN n_trades>=2 THEN rv ELSE 0 END rv_intrabar,
         CASE WHEN n_trades>=2 THEN greatest(0, CASE WHEN close_price>=open_price THEN -ln(low/open_price) ELSE ln(high/open_price) END*1e4) ELSE 0 END mae_intrabar,
         (close_ns-interval_start)::DOUBLE elapsed_ns, CASE WHEN n_trades>0 THEN ln(1+n_trades*1e9/greatest(close_ns-interval_start,1)) ELSE 0 END event_intensity,
         sin((t_event%{DAY_NS})/{DAY_NS}::DOUBLE*2*pi()) tod_sin, cos((t_event%{DAY_NS})/{DAY_NS}::DOUBLE*2*pi()) tod_cos,
         CASE WHEN prev_target_read_ts IS NULL THEN 'no_prior_read' WHEN least(bid_depth,ask_depth,prev_bid_depth,prev_ask_depth)<2 THEN 'insufficient_depth' END feature_reason,
         least(interval_start, prev_target_read_ts) t_feature_start,
         (ask_0_price-bid_0_price)*0.5/mid*1e4 half_spread_bps, abs(label_mid/mid-1)*1e4 latency_drift_bps,
         abs(label_mid/mid-1)*1e4+0.25 slippage_bps, abs(label_mid/mid-1)*1e4+0.25+2.0 cost_bps
       FROM (SELECT *, bid_0_size+bid_1_size bd, ask_0_size+ask_1_size ad, {', '.join(f'lag({c}) OVER w prev_{c}' for c in PREV)}
         FROM dec_v WHERE reason IS NULL AND NOT day_end_like WINDOW w AS (PARTITION BY symbol ORDER BY t_event))""",
)
FRAGMENTS["cand_v"] = (
    ("feat_v",),
    f"""SELECT *, CASE WHEN is_warmup THEN 'warmup' WHEN feature_reason IS NOT NULL THEN 'feature_rejection'
         WHEN t_feature_start < greatest(seg_start_ns, {P.partition_start_ns}) THEN 'before_start' WHEN t_event-t_feature_start>{P.lookback_cap_ns} THEN 'lookback_cap' END drop_reason FROM feat_v""",
)
FRAGMENTS["lost_v"] = (
    ("dec_v",),
    """SELECT *, CASE WHEN is_warmup THEN 'warmup' WHEN day_end_like THEN 'day_end_truncation' WHEN reason='stale_book' THEN 'staleness' ELSE 'book_rejection' END drop_reason
       FROM dec_v WHERE reason IS NOT NULL OR day_end_like""",
)
FRAGMENTS["spath_v"] = (
    ("mid_path_v", "seg_v"),
    "SELECT p.symbol, s.seg, p.ts, p.mid FROM mid_path_v p JOIN seg_v s ON s.symbol=p.symbol AND s.dt=cast(make_timestamp(p.ts//1000) AS date)",
)
FRAGMENTS["vol_v"] = (
    ("spath_v",),
    f"""SELECT symbol, seg, ts, mid, coalesce(count(rt) OVER w,0) n_returns, sqrt(sum(rt*rt*k) OVER w / sum(CASE WHEN rt IS NOT NULL THEN k END) OVER w) vol_bps FROM (
         SELECT *, (mid-pm)/pm*1e4 rt, pow(2.0::DOUBLE, (ts-t0)/{P.halflife_ns}::DOUBLE) k FROM (
           SELECT *, lag(mid) OVER (PARTITION BY symbol, seg ORDER BY ts) pm, min(ts) OVER (PARTITION BY symbol, seg) t0 FROM spath_v))
       WINDOW w AS (PARTITION BY symbol, seg ORDER BY ts)""",
)
FRAGMENTS["width_v"] = (
    ("cand_v", "vol_v"),
    """SELECT *, CASE WHEN n_returns>=5 AND w>0 THEN w END width_bps, CASE WHEN n_returns<5 THEN 'insufficient_vol_history' WHEN w<=0 THEN 'degenerate_barrier_width' END label_reason FROM (
         SELECT c.symbol, c.seg, c.t_event, c.label_mid p0, v.mid path_mid, v.vol_bps, coalesce(v.n_returns,0) n_returns, greatest(coalesce(v.vol_bps,0), 0.5)*1.0 w
         FROM (SELECT * FROM cand_v WHERE drop_reason IS NULL) c ASOF LEFT JOIN vol_v v ON v.symbol=c.symbol AND v.seg=c.seg AND v.ts<=c.t_event)""",
)
HZ = "(VALUES " + ", ".join(f"('{t}', {n})" for t, n in P.horizons.items()) + ") h(horizon, horizon_ns)"
PEND = P.partition_end_ns
FRAGMENTS["hrows_v"] = (
    ("cand_v", "width_v"),
    f"""SELECT *, coalesce(CASE WHEN up>={PEND} THEN 'prefilter' WHEN seg_end_ns<{PEND} AND up>=seg_end_ns THEN 'coverage_gap' END, CASE WHEN label_reason IS NOT NULL THEN 'label_rejection' END) dr FROM (
         SELECT c.* EXCLUDE (drop_reason), w.p0, w.width_bps, w.label_reason, h.horizon, h.horizon_ns, c.t_event+h.horizon_ns+{P.guard_ns} up
         FROM cand_v c JOIN width_v w USING (symbol, seg, t_event), {HZ} WHERE c.drop_reason IS NULL)""",
)
FRAGMENTS["lbl_v"] = (
    ("hrows_v", "spath_v"),
    """SELECT symbol, seg, t_event, horizon, p0, width_bps, coalesce(hit.ret, coalesce(last_ret, 0)) y_fwd_bps, cast(coalesce(sign(hit.ret),0) AS bigint) AS label, coalesce(hit.ts, t_event+horizon_ns) t_barrier FROM (
         SELECT a.symbol, a.seg, a.t_event, a.horizon, a.horizon_ns, a.p0, a.width_bps, arg_max(ret, ts) last_ret,
           arg_min({'ts': ts, 'ret': ret}, ts) FILTER (WHERE abs(ret)>=width_bps) hit
         FROM (SELECT h.*, s.ts, (s.mid-h.p0)/h.p0*1e4 ret FROM (SELECT * FROM hrows_v WHERE dr IS NULL) h
           LEFT JOIN spath_v s ON s.symbol=h.symbol AND s.seg=h.seg AND s.ts>h.t_event AND s.ts<=h.t_event+h.horizon_ns) a
         GROUP BY ALL)""",
)
FRAGMENTS["lbl_v"] = (
    FRAGMENTS["lbl_v"][0],
    FRAGMENTS["lbl_v"][1].replace("SELECT h.*, s.ts", "SELECT h.symbol, h.seg, h.t_event, h.horizon, h.horizon_ns, h.p0, h.width_bps, s.ts"),
)
FRAGMENTS["minvalid_v"] = (("invalid_v", "mdays_v"), "SELECT * FROM invalid_v SEMI JOIN mdays_v USING (symbol, dt)")
FRAGMENTS["rows_v"] = (
    ("hrows_v", "lbl_v", "minvalid_v"),
    f"""SELECT *, coalesce(dr, CASE WHEN hitbad THEN 'coverage_gap' WHEN t_barrier+{P.guard_ns}>=least(seg_end_ns,{PEND}) THEN 'actual_span' END) drop_reason FROM (
         SELECT h.*, l.y_fwd_bps, l.label, l.t_barrier, EXISTS (SELECT 1 FROM minvalid_v i WHERE i.symbol=h.symbol AND i.start_ns<=l.t_barrier AND i.end_ns>h.t_event+0 AND i.end_ns-1>=h.t_event+1) hitbad
         FROM hrows_v h LEFT JOIN lbl_v l USING (symbol, seg, t_event, horizon))""",
)
FRAGMENTS["model_v"] = (
    ("rows_v",),
    "SELECT symbol, horizon, t_event, t_barrier, t_feature_start, t_event t_available, "
    + ", ".join(c if c == "elapsed_ns" else f"round({c},6)+0.0 {c}" for c in FEATURE_COLS)
    + """, round(1e4*ln(1+y_fwd_bps/1e4),6)+0.0 y_fwd_bps, label, round(cost_bps,6)+0.0 cost_bps, round(half_spread_bps,6)+0.0 half_spread_bps, round(latency_drift_bps,6)+0.0 latency_drift_bps,
       close_reason='time_cap' emitted_by_time_cap, CASE WHEN spread_tick<=3 THEN 'tight' ELSE 'wide' END regime,
       round(1.0/(SELECT count(*) FROM rows_v b WHERE b.drop_reason IS NULL AND b.symbol=a.symbol AND b.horizon=a.horizon AND b.t_event<=a.t_event AND b.t_barrier>a.t_event),6)+0.0 uniqueness
       FROM rows_v a WHERE drop_reason IS NULL""",
)


# ------------------------------------------------------------------ Spark side
def mdays(t: Tables):
    return t.days.filter(F.dayofmonth("dt") != 15)


def mtrades(t: Tables):
    return t.stored("trades").join(mdays(t), ["symbol", "dt"], "left_semi")


def schedule(t: Tables):
    totals = mdays(t).join(B.day_totals(t.stored("trades")), ["symbol", "dt"], "left")
    totals = totals.withColumns({"notional": F.coalesce("notional", F.lit(0.0)), "coverage": F.lit(1.0)})
    return B.threshold_schedule(totals, window_days=7, warmup_days=2, target_bars=12, seed_threshold=27_000.0)


def bars(t: Tables):
    return B.dollar_bars(mtrades(t), schedule(t), P.time_cap_ns)


def decided(t: Tables):
    return B.coalesce_bars(B.decision_watermark(materialize(bars(t))))


def reads(t: Tables):
    return dual_book_reads(t.deltas_clean, materialize(decided(t)), staleness_cap_ns=P.staleness_cap_ns, top_k=2)


def build(t: Tables, checks: StageChecks | None = None) -> M.MatrixBuild:
    return M.model_matrix(t.stored("trades"), t.deltas_clean, materialize(mdays(t)), PARAMS, checks)


@query("threshold_schedule", sql("SELECT symbol, dt, round(threshold,4)+0.0 threshold, is_warmup FROM sched_v", "sched_v"))
def threshold_schedule(t: Tables):
    return rnd(schedule(t), "threshold", d=4)


BAR_SQL = "symbol, dt, bar_idx, interval_start, close_reason, cap_fire, round(notional,4)+0.0 notional, n_trades, max_received"


@query("dollar_bars", sql(f"SELECT {BAR_SQL} FROM bars_v", "bars_v"))
def dollar_bars(t: Tables):
    b = bars(t).select("symbol", "dt", "bar_idx", "interval_start", "close_reason", "cap_fire", "notional", "n_trades", "max_received")
    return rnd(b, "notional", d=4)


@query("dollar_bars_in_chunks", sql(f"SELECT {BAR_SQL} FROM bars_v", "bars_v"))
def dollar_bars_in_chunks(t: Tables):
    """The same bars with every symbol-day in eight tasks."""
    b = B.dollar_bars(mtrades(t), schedule(t), P.time_cap_ns, width=DAY_NS // 8)
    return rnd(b.select("symbol", "dt", "bar_idx", "interval_start", "close_reason", "cap_fire", "notional", "n_trades", "max_received"), "notional", d=4)


@query(
    "bar_members",
    sql("SELECT symbol, dt, bar_idx, seq FROM (SELECT symbol, dt, tbar bar_idx, seq, rn FROM clock_v) WHERE rn>0", "clock_v"),
)
def bar_members(t: Tables):
    return B.tagged_bars(mtrades(t), schedule(t), P.time_cap_ns).filter("seq IS NOT NULL").select("symbol", "dt", "bar_idx", "seq")


@query("decision_watermark", sql("SELECT symbol, dt, bar_idx, t_event FROM water_v", "water_v"))
def decision_watermark(t: Tables):
    return B.decision_watermark(materialize(bars(t))).select("symbol", "dt", "bar_idx", "t_event")


@query("coalesce_bars", sql("SELECT symbol, t_event, dt, bar_idx, close_reason FROM decisions_v", "decisions_v"))
def coalesce_bars(t: Tables):
    return decided(t).select("symbol", "t_event", "dt", "bar_idx", "close_reason")


@query(
    "bar_time_diagnostics",
    sql("SELECT symbol, dt, bar_idx, close_reason, close_ns, close_ns-interval_start elapsed_ns, close_reason='time_cap' emitted_by_time_cap FROM water_v", "water_v"),
)
def bar_time_diagnostics(t: Tables):
    return B.bar_diagnostics(bars(t))


FLOW = ["cvd", "signed_vol", "aggressor_imb", "largest_print", "trade_count", "rv_intrabar", "mae_intrabar"]


@query(
    "bar_features",
    sql(
        """SELECT symbol, dt, bar_idx, round(CASE WHEN n_trades>0 THEN signed_notional/threshold ELSE 0 END,6)+0.0 cvd,
             round(CASE WHEN n_trades>0 THEN signed_amount/total_amount ELSE 0 END,6)+0.0 signed_vol, round(CASE WHEN n_trades>0 THEN (2*n_buy-n_trades)/n_trades::DOUBLE ELSE 0 END,6)+0.0 aggressor_imb,
             round(CASE WHEN n_trades>0 THEN largest_notional/threshold ELSE 0 END,6)+0.0 largest_print, n_trades::DOUBLE trade_count,
             round(CASE WHEN n_trades>=2 THEN rv ELSE 0 END,6)+0.0 rv_intrabar,
             round(CASE WHEN n_trades>=2 THEN greatest(0, CASE WHEN close_price>=open_price THEN -ln(low/open_price) ELSE ln(high/open_price) END*1e4) ELSE 0 END,6)+0.0 mae_intrabar
           FROM bars_v""",
        "bars_v",
    ),
)
def bar_features(t: Tables):
    return rnd(bars(t).withColumns({**B.trade_flow(), **B.intrabar_path()}).select("symbol", "dt", "bar_idx", *FLOW), *FLOW)


@query(
    "bar_clock_features",
    sql(
        f"""SELECT symbol, t_event, (close_ns-interval_start)::DOUBLE elapsed_ns, round(CASE WHEN n_trades>0 THEN ln(1+n_trades*1e9/greatest(close_ns-interval_start,1)) ELSE 0 END,6)+0.0 event_intensity,
            round(sin((t_event%{DAY_NS})/{DAY_NS}::DOUBLE*2*pi()),6)+0.0 tod_sin, round(cos((t_event%{DAY_NS})/{DAY_NS}::DOUBLE*2*pi()),6)+0.0 tod_cos FROM decisions_v""",
        "decisions_v",
    ),
)
def bar_clock_features(t: Tables):
    x = decided(t).withColumns(B.clock_features()).select("symbol", "t_event", "elapsed_ns", "event_intensity", "tod_sin", "tod_cos")
    return rnd(x, "event_intensity", "tod_sin", "tod_cos")


READ_COLS = ["symbol", "t_event", "role", "reason", "target_read_ts", "bid_depth", "ask_depth", *LEVELS]


@query(
    "dual_book_reads",
    sql(f"SELECT {', '.join(READ_COLS)}, round(mid,6)+0.0 mid, round(microprice,6)+0.0 microprice, round(label_mid,6)+0.0 label_mid, round(label_microprice,6)+0.0 label_microprice FROM reads_v", "reads_v"),
)
def dual_reads(t: Tables):
    m = ["mid", "microprice", "label_mid", "label_microprice"]
    return rnd(reads(t).select(*READ_COLS, *m), *m)


@query(
    "dual_axis_asof",
    sql(
        """SELECT symbol, sample_ts, max(tick) FILTER (WHERE side='bid') best_bid, min(tick) FILTER (WHERE side='ask') best_ask, count(size) n_levels FROM grid_v
           LEFT JOIN (SELECT p.symbol, p.sample_ts, d.side, d.tick, arg_max(d.size, row(d.origin_ns, d.seq)) size FROM grid_v p JOIN deltas_v d
             ON d.symbol=p.symbol AND d.received_ns<=p.sample_ts GROUP BY 1,2,3,4 HAVING arg_max(d.size, row(d.origin_ns, d.seq))>0) USING (symbol, sample_ts) GROUP BY 1,2""",
        "grid_v",
        "deltas_v",
    ),
)
def dual_axis_asof(t: Tables):
    from lobspark.operators.book import book_asof

    k = book_asof(observable_deltas(t.deltas), t.grid, k=1, ts="received_ns")
    return k.select(
        "symbol", "sample_ts", F.round(F.col("bid_0_price") * 100).cast("bigint").alias("best_bid"),
        F.round(F.col("ask_0_price") * 100).cast("bigint").alias("best_ask"), (F.col("bid_depth") + F.col("ask_depth")).alias("n_levels"),
    )


COSTS = ["half_spread_bps", "latency_drift_bps", "slippage_bps", "cost_bps"]
BOOKF = ["ofi_integrated", "microprice_dev", "queue_imb", "spread_tick", "depth_imbalance", "book_slope", "vwap_minus_mid"]


def candidates(t: Tables):
    b = materialize(decided(t))
    rd = dual_book_reads(t.deltas_clean, b, staleness_cap_ns=P.staleness_cap_ns, top_k=2)
    return M.candidate_rows(b, rd, M.contiguous_segments(mdays(t)), PARAMS)


@query(
    "book_features",
    sql("SELECT symbol, t_event, " + ", ".join(f"round({c},6)+0.0 {c}" for c in BOOKF) + ", feature_reason, t_feature_start FROM feat_v WHERE feature_reason IS NULL", "feat_v"),
)
def book_features(t: Tables):
    c = candidates(t).filter("feature_reason IS NULL AND reason IS NULL AND NOT day_end_like")
    return rnd(c.select("symbol", "t_event", *BOOKF, "feature_reason", "t_feature_start"), *BOOKF)


@query("feature_rejections", sql("SELECT symbol, t_event, feature_reason FROM feat_v WHERE feature_reason IS NOT NULL", "feat_v"))
def feature_rejections(t: Tables):
    return candidates(t).filter("feature_reason IS NOT NULL").select("symbol", "t_event", "feature_reason")


@query("bar_costs", sql("SELECT symbol, t_event, " + ", ".join(f"round({c},6)+0.0 {c}" for c in COSTS) + " FROM feat_v", "feat_v"))
def bar_costs_query(t: Tables):
    c = candidates(t).filter("reason IS NULL AND NOT day_end_like").select("symbol", "t_event", *COSTS)
    return rnd(c, *COSTS)


@query(
    "bar_drop_reasons",
    sql("SELECT drop_reason, count(*) n FROM (SELECT drop_reason FROM cand_v UNION ALL SELECT drop_reason FROM lost_v) GROUP BY 1", "cand_v", "lost_v"),
)
def bar_drop_reasons(t: Tables):
    return candidates(t).groupBy("drop_reason").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ labels
def seg_path(t: Tables):
    from lobspark.operators.book import coalesce_path, day_of

    p = coalesce_path(t.mid_points).withColumn("dt", day_of("ts"))
    s = M.contiguous_segments(mdays(t)).select("symbol", "dt", "seg")
    return materialize(p.join(s, ["symbol", "dt"]).select("symbol", "seg", "ts", "mid"))


@query("coalesce_path", sql("SELECT symbol, seg, count(*) n, min(ts) first_ts, max(ts) last_ts, round(avg(mid),6)+0.0 mean_mid FROM spath_v GROUP BY 1,2", "spath_v"))
def coalesce_path_query(t: Tables):
    return seg_path(t).groupBy("symbol", "seg").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), r(F.avg("mid")).alias("mean_mid")
    )


@query("ewma_vol", sql("SELECT symbol, seg, ts, n_returns, round(vol_bps,6)+0.0 vol_bps FROM vol_v", "vol_v"))
def ewma_vol(t: Tables):
    v = L.ewma_vol(seg_path(t), ["symbol", "seg"], P.halflife_ns, width=4 * P.halflife_ns)
    return rnd(v.select("symbol", "seg", "ts", "n_returns", "vol_bps"), "vol_bps")


FRAGMENTS["tanchor_v"] = (
    ("bt_v", "seg_v", "spath_v"),
    "SELECT t.symbol, s.seg, t.origin_ns t_event, p.mid p0 FROM bt_v t JOIN seg_v s USING (symbol, dt) ASOF JOIN spath_v p ON p.symbol=t.symbol AND p.seg=s.seg AND p.ts<=t.origin_ns",
)
FRAGMENTS["twidth_v"] = (
    ("tanchor_v", "vol_v"),
    """SELECT *, CASE WHEN n_returns>=5 AND w>0 THEN w END width_bps, CASE WHEN n_returns<5 THEN 'insufficient_vol_history' WHEN w<=0 THEN 'degenerate_barrier_width' END label_reason FROM (
         SELECT a.*, coalesce(v.n_returns,0) n_returns, greatest(coalesce(v.vol_bps,0),0.5) w FROM tanchor_v a ASOF LEFT JOIN vol_v v ON v.symbol=a.symbol AND v.seg=a.seg AND v.ts<=a.t_event)""",
)


def trade_anchors(t: Tables):
    from lobspark.operators.ordered import asof

    path = seg_path(t)
    a = mtrades(t).join(M.contiguous_segments(mdays(t)).select("symbol", "dt", "seg"), ["symbol", "dt"])
    a = a.select("symbol", "seg", F.col("origin_ns").alias("t_event"))
    a = materialize(asof(a, path, ["symbol", "seg"], left_ts="t_event", right_ts="ts", cols={"p0": F.col("mid")}).filter("p0 IS NOT NULL"))
    vol = materialize(L.ewma_vol(path, ["symbol", "seg"], P.halflife_ns))
    w = L.anchors_with_width(vol, a, ["symbol", "seg"], width_mult=1.0, vol_floor_bps=0.5, min_returns=5)
    return path, w


@query("barrier_width", sql("SELECT symbol, seg, t_event, n_returns, round(width_bps,6)+0.0 width_bps, label_reason FROM twidth_v", "twidth_v"))
def barrier_width(t: Tables):
    w = trade_anchors(t)[1]
    return rnd(w.select("symbol", "seg", "t_event", "n_returns", "width_bps", "label_reason"), "width_bps")


@query(
    "triple_barrier",
    sql(
        f"""SELECT symbol, seg, t_event, horizon, round(coalesce(hit.ret, coalesce(last_ret,0)),6)+0.0 y_fwd_bps, cast(coalesce(sign(hit.ret),0) AS bigint) AS label, coalesce(hit.ts, t_event+horizon_ns) t_barrier FROM (
              SELECT a.symbol, a.seg, a.t_event, h.horizon, h.horizon_ns, arg_max((s.mid-p0)/p0*1e4, s.ts) last_ret,
                arg_min({{'ts': s.ts, 'ret': (s.mid-p0)/p0*1e4}}, s.ts) FILTER (WHERE abs((s.mid-p0)/p0*1e4)>=width_bps) hit
              FROM twidth_v a CROSS JOIN {HZ} LEFT JOIN spath_v s ON s.symbol=a.symbol AND s.seg=a.seg AND s.ts>a.t_event AND s.ts<=a.t_event+h.horizon_ns
              WHERE a.width_bps IS NOT NULL GROUP BY 1,2,3,4,5)""",
        "twidth_v",
        "spath_v",
    ),
)
def triple_barrier(t: Tables):
    path, w = trade_anchors(t)
    a = M.horizon_rows(w.filter("width_bps IS NOT NULL"), P.horizons)
    out = L.triple_barrier(path, a, ["symbol", "seg"], longest=max(P.horizons.values()))
    return rnd(out.select("symbol", "seg", "t_event", "horizon", "y_fwd_bps", "label", "t_barrier"), "y_fwd_bps")


@query(
    "label_coverage_gate",
    sql(
        f"""SELECT symbol, seg, count(*) n_anchors, 0::BIGINT no_path_point, 0::BIGINT p0_mismatch, count(*) FILTER (WHERE t_event+{4 * H}>{DAY0 + 28 * DAY_NS}) window_past_coverage FROM tanchor_v GROUP BY 1,2""",
        "tanchor_v",
    ),
)
def label_coverage_gate(t: Tables):
    return L.coverage_gate(trade_anchors(t)[1], ["symbol", "seg"], 4 * H, F.lit(DAY0 + 28 * DAY_NS))


@query("contiguous_segments", sql("SELECT * FROM seg_v", "seg_v"))
def contiguous_segments(t: Tables):
    return M.contiguous_segments(mdays(t))


@query(
    "horizon_prefilter",
    sql(
        f"""SELECT t.symbol, t.seq, h.horizon, CASE WHEN origin_ns+horizon_ns+{P.guard_ns}>={PEND} THEN 'prefilter' WHEN seg_end_ns<{PEND} AND origin_ns+horizon_ns+{P.guard_ns}>=seg_end_ns THEN 'coverage_gap' END reason
            FROM bt_v t JOIN seg_v s USING (symbol, dt) CROSS JOIN {HZ}""",
        "bt_v",
        "seg_v",
    ),
)
def horizon_prefilter(t: Tables):
    a = mtrades(t).join(M.contiguous_segments(mdays(t)), ["symbol", "dt"]).select("symbol", "seq", F.col("origin_ns").alias("t_event"), "seg_end_ns")
    return M.horizon_rows(a, P.horizons).select("symbol", "seq", "horizon", M.prefilter_reason(P.guard_ns, PEND).alias("reason"))


MCOLS = [*FEATURE_COLS, "y_fwd_bps", "cost_bps", "half_spread_bps", "latency_drift_bps", "uniqueness"]


@query("model_matrix", sql("SELECT * FROM model_v", "model_v"))
def model_matrix(t: Tables):
    return rnd(build(t).matrix, *MCOLS)


@query(
    "drop_counts",
    sql(
        f"""SELECT drop_reason category, horizon, count(*) n FROM (
              SELECT drop_reason, horizon FROM (SELECT drop_reason FROM cand_v UNION ALL SELECT drop_reason FROM lost_v) CROSS JOIN {HZ} WHERE drop_reason IS NOT NULL
              UNION ALL SELECT drop_reason, horizon FROM rows_v WHERE drop_reason IS NOT NULL) GROUP BY 1,2""",
        "cand_v",
        "lost_v",
        "rows_v",
    ),
)
def drop_counts(t: Tables):
    return M.drop_counts(build(t), P.horizons)


@query(
    "invalid_window_mask",
    sql("SELECT symbol, t_event, horizon, t_barrier FROM rows_v WHERE dr IS NULL AND hitbad", "rows_v"),
)
def invalid_window_mask(t: Tables):
    b = build(t)
    return b.rows.join(
        M.invalid_window_hits(b.rows.filter("t_barrier IS NOT NULL"), b.invalid, ["symbol"], DAY_NS), ["symbol", "t_event", "horizon"], "left_semi"
    ).select("symbol", "t_event", "horizon", "t_barrier")


@query("actual_span_filter", sql("SELECT symbol, t_event, horizon, t_barrier FROM rows_v WHERE drop_reason='actual_span'", "rows_v"))
def actual_span_filter(t: Tables):
    return build(t).rows.filter("drop_reason = 'actual_span'").select("symbol", "t_event", "horizon", "t_barrier")

