"""Trade-feed validation queries (one aggregate job over all venue-days each)."""

from pyspark.sql import functions as F

from lobspark.operators import trades as T
from lobspark.plans.common import r
from lobspark.plans.registry import query
from lobspark.plans.tables import FRAGMENTS, Tables, sql

SENT = T.SENTINEL_NS
FRAGMENTS["feed_v"] = (
    ("trades_v",),
    """SELECT symbol venue, cast(dt + cast(CASE WHEN seq%1009=0 THEN 1 ELSE 0 END AS integer) AS date) dt,
       CASE WHEN seq%97=0 THEN NULL WHEN seq%101=0 THEN 0 ELSE origin_ns END origin_ns,
       CASE WHEN seq%194=0 THEN NULL WHEN seq%401=0 THEN origin_ns-1000000 ELSE received_ns END received_ns,
       seq, CASE WHEN seq%89=0 THEN seq-10 ELSE seq END pos,
       CASE WHEN seq%499=0 THEN NULL WHEN seq%503=0 THEN price*20 ELSE price END price,
       CASE WHEN seq%211=0 THEN 0.0 WHEN seq%307=0 THEN -quantity ELSE quantity END quantity,
       CASE WHEN seq%257=0 THEN 'unknown' ELSE side END side,
       CASE WHEN seq%10=1 THEN seq-1 ELSE seq END trade_id FROM trades_v""",
)
FRAGMENTS["clocked_v"] = (
    ("feed_v",),
    f"""SELECT *, CASE WHEN origin_ns >= {SENT} THEN origin_ns WHEN received_ns >= {SENT} THEN received_ns END clock,
       (origin_ns IS NULL OR origin_ns < {SENT}) origin_null FROM feed_v""",
)
FRAGMENTS["ordered_v"] = (
    ("clocked_v",),
    """SELECT *, (clock - lag(clock) OVER w)/1e9 gap_s, abs(price - lag(price) OVER w)/lag(price) OVER w abs_ret
       FROM clocked_v WHERE clock IS NOT NULL WINDOW w AS (PARTITION BY venue, dt ORDER BY clock, pos)""",
)


def feed(t: Tables):
    """A trade feed with planted faults: absent clocks, odd prices and sizes, repeats, disorder."""
    s = F.col("seq")

    def at(m: int, v=0):
        return s % m == v

    tr = t.stored("trades")
    return tr.select(
        F.col("symbol").alias("venue"),
        F.date_add("dt", F.when(at(1009), 1).otherwise(0)).alias("dt"),
        F.when(at(97), None).when(at(101), 0).otherwise(F.col("origin_ns")).cast("bigint").alias("origin_ns"),
        F.when(at(194), None).when(at(401), F.col("origin_ns") - 1_000_000).otherwise(F.col("received_ns")).cast("bigint").alias("received_ns"),
        "seq",
        F.when(at(89), s - 10).otherwise(s).alias("pos"),
        F.when(at(499), None).when(at(503), F.col("price") * 20).otherwise(F.col("price")).alias("price"),
        F.when(at(211), 0.0).when(at(307), -F.col("quantity")).otherwise(F.col("quantity")).alias("quantity"),
        F.when(at(257), "unknown").otherwise(F.col("side")).alias("side"),
        F.when(at(10, 1), s - 1).otherwise(s).alias("trade_id"),
    )


def keyed(df, *floats):
    return df.withColumns({c: r(c) for c in floats})


Q = "round({0},6)+0.0"

SQL_DUP_IDS = "SELECT venue, dt, count(*)-count(DISTINCT trade_id) dup_trade_id_count, round((count(*)-count(DISTINCT trade_id))/count(*)::DOUBLE,6)+0.0 dup_trade_id_frac FROM feed_v GROUP BY 1,2"
SQL_DUP_TS = "SELECT venue, dt, count(*) FILTER (WHERE n>1) dup_ts_cluster_count, max(n) dup_ts_max_cluster FROM (SELECT venue, dt, clock, count(*) n FROM clocked_v WHERE clock IS NOT NULL GROUP BY 1,2,3) GROUP BY 1,2"
SQL_PRICE = """SELECT f.venue, f.dt, min(price) price_min, max(price) price_max, round(any_value(med),6)+0.0 price_median,
  count(*) FILTER (WHERE med>0 AND (price < med/10 OR price > med*10)) price_out_of_band_count,
  count(*) FILTER (WHERE price IS NULL) price_nonfinite_count,
  round(coalesce(any_value(p99),0),6)+0.0 price_p99_abs_ret, round(coalesce(any_value(mx),0),6)+0.0 price_max_abs_ret
  FROM feed_v f JOIN (SELECT venue, dt, quantile_cont(price,0.5) med FROM feed_v GROUP BY 1,2) m USING (venue, dt)
  LEFT JOIN (SELECT venue, dt, quantile_cont(abs_ret,0.99) p99, max(abs_ret) mx FROM ordered_v GROUP BY 1,2) o USING (venue, dt)
  GROUP BY 1,2"""
SQL_SIZE = "SELECT venue, dt, min(quantity) size_min, max(quantity) size_max, round(avg((quantity=0)::INT),6)+0.0 size_zero_frac, round(avg((quantity<0)::INT),6)+0.0 size_neg_frac FROM feed_v GROUP BY 1,2"
SQL_NOTIONAL = "SELECT venue, dt, round(sum(price*quantity),4)+0.0 notional_sum, round(max(price*quantity),4)+0.0 notional_max_trade FROM feed_v GROUP BY 1,2"
SQL_GAP = """SELECT venue, dt, round(coalesce(quantile_cont(gap_s,0.5),0),3)+0.0 interarrival_median_s, round(coalesce(quantile_cont(gap_s,0.95),0),3)+0.0 interarrival_p95_s,
  round(coalesce(quantile_cont(gap_s,0.99),0),3)+0.0 interarrival_p99_s, round(coalesce(max(gap_s),0),3)+0.0 interarrival_max_s
  FROM (SELECT DISTINCT venue, dt FROM feed_v) LEFT JOIN ordered_v USING (venue, dt) GROUP BY 1,2"""
FRAGMENTS["hours_v"] = (
    ("clocked_v",),
    """SELECT venue, dt, h, count(clock) n FROM (SELECT DISTINCT venue, dt FROM clocked_v) CROSS JOIN (SELECT unnest(range(24)) h)
       LEFT JOIN (SELECT venue, dt, clock, (clock - epoch_us(cast(dt AS timestamp))*1000)//3600000000000 h,
                  clock - epoch_us(cast(dt AS timestamp))*1000 off FROM clocked_v WHERE clock IS NOT NULL) c
         USING (venue, dt, h) WHERE off IS NULL OR off BETWEEN 0 AND 86399999999999 GROUP BY 1,2,3""",
)
SQL_HOURS = """SELECT venue, dt, count(*) FILTER (WHERE n=0) missing_hour_count, count(*) FILTER (WHERE n>0 AND n<4) sparse_hour_count,
  coalesce(string_agg(h::VARCHAR, ',' ORDER BY h) FILTER (WHERE n=0), '') missing_hours,
  coalesce(string_agg(h::VARCHAR, ',' ORDER BY h) FILTER (WHERE n>0 AND n<4), '') sparse_hours FROM hours_v GROUP BY 1,2"""
SQL_LAG = f"""SELECT venue, dt, round(quantile_cont(l,0.5),6)+0.0 recv_origin_lag_median_ms, round(quantile_cont(l,0.95),6)+0.0 recv_origin_lag_p95_ms,
  round(coalesce(avg((l<0)::INT),0),6)+0.0 recv_origin_lag_neg_frac FROM (SELECT venue, dt, CASE WHEN origin_ns>={SENT} AND received_ns>={SENT} THEN (received_ns-origin_ns)/1e6 END l FROM feed_v) GROUP BY 1,2"""
SQL_OFF = """SELECT venue, dt, round(coalesce(avg((o<0 OR o>=86400000000000)::INT),0),6)+0.0 off_day_frac
  FROM (SELECT venue, dt, clock-epoch_us(cast(dt AS timestamp))*1000 o FROM clocked_v) GROUP BY 1,2"""
SQL_FLAGS = f"""SELECT venue, dt, count(*) row_count, round(avg(origin_null::INT),6)+0.0 origin_null_frac,
  round(avg((received_ns IS NULL OR received_ns<{SENT})::INT),6)+0.0 received_null_frac,
  count(*) FILTER (WHERE clock IS NULL) unresolved_count,
  NOT bool_or(origin_ns IS NULL OR coalesce(origin_ns < p, false)) was_presorted, min(clock) first_ns, max(clock) last_ns,
  count(*) FILTER (WHERE side NOT IN ('buy','sell')) side_unexpected
  FROM (SELECT *, lag(origin_ns) OVER (PARTITION BY venue, dt ORDER BY pos) p FROM clocked_v) GROUP BY 1,2"""


@query("dup_trade_ids", sql(SQL_DUP_IDS, "feed_v"))
def dup_trade_ids(t: Tables):
    return keyed(T.dup_trade_ids(feed(t)), "dup_trade_id_frac")


@query("dup_timestamp_clusters", sql(SQL_DUP_TS, "clocked_v"))
def dup_timestamp_clusters(t: Tables):
    return T.dup_timestamp_clusters(feed(t))


@query("price_checks", sql(SQL_PRICE, "feed_v", "ordered_v"))
def price_checks(t: Tables):
    return keyed(T.price_checks(feed(t)), "price_median", "price_p99_abs_ret", "price_max_abs_ret")


@query("size_checks", sql(SQL_SIZE, "feed_v"))
def size_checks(t: Tables):
    return keyed(T.size_checks(feed(t)), "size_zero_frac", "size_neg_frac")


@query("notional_checks", sql(SQL_NOTIONAL, "feed_v"))
def notional_checks(t: Tables):
    return T.notional_checks(feed(t)).withColumns({c: r(c, 4) for c in ("notional_sum", "notional_max_trade")})


GAPS = ["interarrival_median_s", "interarrival_p95_s", "interarrival_p99_s", "interarrival_max_s"]


@query("interarrival", sql(SQL_GAP, "feed_v", "ordered_v"))
def interarrival(t: Tables):
    return T.interarrival(feed(t)).withColumns({c: r(c, 3) for c in GAPS})


def flat_hours(df):
    return df.withColumns(
        {
            "missing_hour_count": F.size("missing_hours").cast("bigint"),
            "sparse_hour_count": F.size("sparse_hours").cast("bigint"),
            "missing_hours": F.array_join(F.col("missing_hours").cast("array<string>"), ","),
            "sparse_hours": F.array_join(F.col("sparse_hours").cast("array<string>"), ","),
        }
    )


@query("hour_coverage", sql(SQL_HOURS, "hours_v"))
def hour_coverage(t: Tables):
    return flat_hours(T.hour_coverage(feed(t), sparse_min_rows=4))


LAGS = ["recv_origin_lag_median_ms", "recv_origin_lag_p95_ms", "recv_origin_lag_neg_frac"]


@query("lag_metrics", sql(SQL_LAG, "feed_v"))
def lag_metrics(t: Tables):
    return keyed(T.lag_metrics(feed(t)), *LAGS)


@query("off_day_fraction", sql(SQL_OFF, "clocked_v"))
def off_day_fraction(t: Tables):
    return keyed(T.off_day_fraction(feed(t)), "off_day_frac")


@query("side_values", sql("SELECT venue, dt, side, count(*) n FROM feed_v GROUP BY 1,2,3", "feed_v"))
def side_values(t: Tables):
    return T.side_values(feed(t))


@query("clock_flags", sql(SQL_FLAGS, "clocked_v"))
def clock_flags(t: Tables):
    return keyed(T.clock_flags(feed(t)), "origin_null_frac", "received_null_frac")


@query(
    "engine_clock",
    sql("SELECT venue, seq, clock, origin_null, clock IS NULL unresolved FROM clocked_v", "clocked_v"),
)
def engine_clock(t: Tables):
    return T.engine_clock(feed(t)).select("venue", "seq", "clock", "origin_null", "unresolved")


METRIC_CTES = {
    "m_flags": SQL_FLAGS, "m_ids": SQL_DUP_IDS, "m_ts": SQL_DUP_TS, "m_price": SQL_PRICE, "m_size": SQL_SIZE,
    "m_notional": SQL_NOTIONAL, "m_gap": SQL_GAP, "m_hours": SQL_HOURS, "m_lag": SQL_LAG, "m_off": SQL_OFF,
}
for _n, _s in METRIC_CTES.items():
    FRAGMENTS[_n] = (("feed_v", "clocked_v", "ordered_v", "hours_v"), _s)
FRAGMENTS["trade_metrics_v"] = (
    tuple(METRIC_CTES),
    "SELECT * REPLACE (coalesce(dup_ts_cluster_count,0) AS dup_ts_cluster_count, coalesce(dup_ts_max_cluster,0) AS dup_ts_max_cluster) "
    "FROM m_flags " + " ".join(f"LEFT JOIN {n} USING (venue, dt)" for n in list(METRIC_CTES)[1:]),
)
FLOATS = [
    "origin_null_frac", "received_null_frac", "dup_trade_id_frac", "price_median", "price_p99_abs_ret",
    "price_max_abs_ret", "size_zero_frac", "size_neg_frac", *LAGS, "off_day_frac",
]
LIMITS = T.TradeThresholds(
    min_rows_hard=50, gap_warn_s=3600.0, sparse_hour_min_rows=4, max_missing_hours=2, origin_null_max=0.03,
    size_max=200.0, size_hard_max=300.0,
)


def metrics(t: Tables):
    m = T.trade_day_metrics(feed(t), LIMITS)
    m = keyed(m, *FLOATS)
    return m.withColumns(
        {**{c: r(c, 4) for c in ("notional_sum", "notional_max_trade")}, **{c: r(c, 3) for c in GAPS}}
    )


@query("trade_day_metrics", sql("SELECT * FROM trade_metrics_v", "trade_metrics_v"))
def trade_day_metrics(t: Tables):
    return flat_hours(metrics(t))


FRAGMENTS["classified_v"] = (
    ("trade_metrics_v",),
    """SELECT *, CASE route WHEN 'excluded' THEN 'excluded' WHEN 'vendor_fill' THEN 'vendor_fill'
         ELSE CASE WHEN len(f)>0 THEN 'fail' WHEN len(w)>0 THEN 'warn' ELSE 'pass' END END status,
       CASE route WHEN 'excluded' THEN 'calendar_excluded_day' WHEN 'vendor_fill' THEN 'vendor_fill_day'
         ELSE CASE WHEN len(f)+len(w)=0 THEN 'ok' ELSE array_to_string(list_concat(f,w), ',') END END reasons
     FROM (SELECT venue, dt, CASE WHEN day(dt)%10=0 THEN 'excluded' WHEN day(dt)%7=0 THEN 'vendor_fill' ELSE 'required' END route,
       list_filter([
         CASE WHEN unresolved_count>0 THEN 'nonmonotonic_after_sort' END,
         CASE WHEN unresolved_count>0 THEN 'received_time_fallback_unavailable' END,
         CASE WHEN unresolved_count=0 AND origin_null_frac>0.03 THEN 'origin_time_null_fraction_high' END,
         CASE WHEN row_count<50 THEN 'row_count_implausibly_low' END,
         CASE WHEN off_day_frac>0.5 THEN 'wrong_day_partition' END,
         CASE WHEN price_nonfinite_count>0 OR price_min IS NULL OR price_min<=0 THEN 'price_out_of_range' END,
         CASE WHEN price_max_abs_ret>0.5 OR price_out_of_band_count>0 THEN 'price_spike' END,
         CASE WHEN size_zero_frac>0 OR size_neg_frac>0 THEN 'size_nonpositive' END,
         CASE WHEN size_max>300 THEN 'size_out_of_band' END,
         CASE WHEN notional_sum IS NULL OR notional_sum<=0 THEN 'notional_nonpositive' END,
         CASE WHEN recv_origin_lag_neg_frac>0.001 THEN 'lag_negative' END,
         CASE WHEN missing_hour_count>2 THEN 'missing_hours_excess' END], lambda x: x IS NOT NULL) f,
       list_filter([
         CASE WHEN unresolved_count=0 AND origin_null_frac>0 AND origin_null_frac<=0.03 THEN 'received_time_fallback_used' END,
         CASE WHEN NOT (price_max_abs_ret>0.5 OR price_out_of_band_count>0) AND price_p99_abs_ret>0.1 THEN 'price_jump_excess' END,
         CASE WHEN NOT (size_max>300) AND size_max>200 THEN 'size_out_of_range' END,
         CASE WHEN dup_ts_max_cluster>50 THEN 'duplicate_timestamp_cluster' END,
         CASE WHEN dup_trade_id_count>0 THEN 'duplicate_trade_id' END,
         CASE WHEN interarrival_max_s>3600 THEN 'interarrival_gap_excess' END,
         CASE WHEN side_unexpected>0 THEN 'side_value_unexpected' END,
         CASE WHEN sparse_hour_count>0 THEN 'sparse_hour' END,
         CASE WHEN missing_hour_count BETWEEN 1 AND 2 THEN 'missing_hour' END], lambda x: x IS NOT NULL) w
       FROM trade_metrics_v)""",
)


def classified(t: Tables):
    d = F.dayofmonth("dt")
    m = metrics(t).withColumn(
        "route", F.when(d % 10 == 0, "excluded").when(d % 7 == 0, "vendor_fill").otherwise("required")
    )
    return T.classify_trade_day(m, LIMITS)


@query("classify_trade_day", sql("SELECT venue, dt, status, reasons FROM classified_v", "classified_v"))
def classify_trade_day(t: Tables):
    return classified(t).select("venue", "dt", "status", F.array_join("reasons", ",").alias("reasons"))


@query(
    "trade_validation_report",
    sql(
        """WITH r AS (SELECT venue, dt, 'primary' src, status FROM classified_v
              UNION ALL SELECT venue, dt, 'secondary', 'pass' FROM classified_v WHERE status='vendor_fill' AND day(dt)%2=0),
            k AS (SELECT DISTINCT venue, dt FROM r WHERE src='secondary' AND status IN ('pass','warn'))
           SELECT venue, count(DISTINCT dt) n_days, count(*) FILTER (WHERE status='pass') n_pass, count(*) FILTER (WHERE status='warn') n_warn,
             count(*) FILTER (WHERE status='fail') n_fail, count(*) FILTER (WHERE status='excluded') n_excluded,
             count(*) FILTER (WHERE status='vendor_fill') n_vendor_fill,
             count(*) FILTER (WHERE status='vendor_fill' AND k.dt IS NULL) n_fill_deferred,
             count(*) FILTER (WHERE status='fail')=0 required_pass,
             count(*) FILTER (WHERE status='fail')=0 AND count(*) FILTER (WHERE status='vendor_fill' AND k.dt IS NULL)=0 bars_ready
           FROM r LEFT JOIN k USING (venue, dt) GROUP BY venue""",
        "classified_v",
    ),
)
def trade_validation_report(t: Tables):
    from lobspark.session import materialize

    c = materialize(classified(t).select("venue", "dt", "status"))
    second = c.filter((F.col("status") == "vendor_fill") & (F.dayofmonth("dt") % 2 == 0)).withColumn("status", F.lit("pass"))
    recs = c.withColumn("vendor_source", F.lit("primary")).unionByName(second.withColumn("vendor_source", F.lit("secondary")))
    return T.validation_report(recs)
