"""Sinks read back, hourly partition checks and stage-input checks."""

import uuid

from pyspark.sql import functions as F

from lobspark.operators import contracts as K
from lobspark.operators import matrix as M
from lobspark.plans.common import r
from lobspark.plans.queries_bars import build
from lobspark.plans.queries_l3 import D0, events
from lobspark.plans.registry import query
from lobspark.plans.tables import Tables, sql
from lobspark.session import HOUR_NS, _shared_folder
from lobspark.sources import scans as S
from lobspark.sources.publish import StageChecks


def folder(t: Tables) -> str:
    return f"{_shared_folder(t.spark)}/lobspark-{uuid.uuid4().hex}"


@query("write_hive", sql("SELECT 'X' exchange, symbol, dt, origin_ns, received_ns, seq, side, price, quantity FROM trades_v", "trades_v"))
def write_hive(t: Tables):
    cols = ["exchange", "symbol", "dt", "origin_ns", "received_ns", "seq", "side", "price", "quantity"]
    out = folder(t)
    S.write_hive(t.trades.withColumn("exchange", F.lit("X")).select(*cols), out, ["origin_ns", "seq"])
    return S.scan_hive(t.spark, out).select(*cols)


@query("write_matrix", sql("SELECT symbol, horizon, count(*) n, count(DISTINCT t_event) n_keys FROM model_v GROUP BY 1,2", "model_v"))
def write_matrix(t: Tables):
    """The matrix published with every stage counted while it is stored, then read back."""
    checks, out = StageChecks(), folder(t)
    M.write_matrix(build(t, checks), out, checks)
    back = t.spark.read.parquet(out)
    return back.groupBy("symbol", "horizon").agg(F.count("*").alias("n"), F.count_distinct("t_event").alias("n_keys"))


@query("scan_trades_csv", sql("SELECT origin_ns, received_ns, price, quantity, side, seq::VARCHAR trade_id, upper(side)||'_ESTIMATED' taker_side FROM trades_v", "trades_v"))
def scan_trades_csv(t: Tables):
    """Trades written as semicolon CSV (gzip) and scanned back."""

    def iso(c):
        return F.concat(F.date_format(F.timestamp_micros(F.expr(f"{c} div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0"))

    raw = t.trades.select(
        iso("origin_ns").alias("time_exchange"), iso("received_ns").alias("time_received"), F.col("seq").cast("string").alias("guid"), "price",
        F.col("quantity").alias("base_amount"), F.concat(F.upper("side"), F.lit("_ESTIMATED")).alias("taker_side"),
    )
    out = folder(t)
    raw.write.option("sep", ";").option("header", True).option("compression", "gzip").csv(out)
    return S.scan_trades_csv(t.spark, out, "2024-01-01").drop("seq", "file")


@query("scan_l3_csv", sql("SELECT order_id::VARCHAR order_id, time_exchange_ns, update_type, side='bid' is_buy, tick/100.0::DOUBLE entry_px, size::DOUBLE entry_sx FROM l3_v", "l3_v"))
def scan_l3_csv(t: Tables):
    """Order events written as two sets of CSV files with different orders of columns, each read by its own header."""
    time = F.concat(F.date_format(F.timestamp_micros(F.expr(f"({D0} + time_exchange_ns) div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.expr("cast(time_exchange_ns div 100 % 10 as string)"))
    raw = events(t).select(
        time.alias("time_exchange"), time.alias("time_received"), "update_type", (F.col("side") == "bid").cast("int").alias("is_buy"),
        (F.col("tick") / 100.0).alias("entry_px"), F.col("size").alias("entry_sx"), F.col("order_id").cast("string").alias("order_id"), (F.col("order_id") % 3 == 0).alias("__third"),
    )
    out, names = folder(t), raw.columns[:-1]
    for part, columns in (("a", names), ("b", names[::-1])):
        rows = raw.where("__third" if part == "a" else "not __third").select(*columns)
        rows.write.option("sep", ";").option("header", True).option("compression", "gzip").csv(f"{out}/{part}")
    back = S.scan_l3_csv(t.spark, f"{out}/*", "2024-01-01", mixed=True)
    return back.select("order_id", "time_exchange_ns", "update_type", "is_buy", "entry_px", "entry_sx")


@query(
    "hour_partition_checks",
    sql(
        f"""WITH h AS (SELECT symbol, (CASE WHEN seq%211=0 THEN origin_ns+{HOUR_NS} ELSE origin_ns END)//{HOUR_NS}*{HOUR_NS} hour_ns, origin_ns FROM trades_v),
            p AS (SELECT symbol, hour_ns, count(*) n, count(*) FILTER (WHERE origin_ns>=hour_ns AND origin_ns<hour_ns+{HOUR_NS}) n_in FROM h GROUP BY 1,2),
            g AS (SELECT *, (hour_ns-lag(hour_ns) OVER (PARTITION BY symbol ORDER BY hour_ns))//{HOUR_NS} st FROM p)
            SELECT symbol, count(*) n_hours, cast(coalesce(sum(st-1) FILTER (WHERE st>1),0) AS bigint) n_missing_hours, round(sum(n_in)/sum(n)::DOUBLE,6)+0.0 fraction_inside, round(min(n_in/n::DOUBLE),6)+0.0 worst_hour_fraction FROM g GROUP BY 1""",
        "trades_v",
    ),
)
def hour_partition_checks(t: Tables):
    moved = F.when(F.col("seq") % 211 == 0, F.col("origin_ns") + HOUR_NS).otherwise(F.col("origin_ns"))
    x = t.trades.withColumn("m", moved).withColumn("hour_ns", F.expr(f"(m div {HOUR_NS}L) * {HOUR_NS}L"))
    out = K.hour_partition_checks(x, ["symbol"], "hour_ns", "origin_ns")
    return out.withColumns({c: r(c) for c in ("fraction_inside", "worst_hour_fraction")})


def rules_sql(stage: str, source: str, rules: dict[str, str]) -> str:
    parts = ", ".join(f"{{'rule': '{n}', 'n': count(*) FILTER (WHERE coalesce({c}, true))}}" for n, c in rules.items())
    return f"SELECT '{stage}' AS stage, unnest([{parts}], recursive := true) FROM {source}"


def bad_sql(c: str, low: str = "<=0") -> str:
    return f"({c} IS NULL OR isnan({c}) OR isinf({c}) OR {c}{low})"


def hit_sql(c: str) -> str:
    return f"coalesce({c}, false)"


READ_SQL = {
    "bad_touch": "(" + " OR ".join(bad_sql(x) for x in ("bid_0_price", "ask_0_price", "bid_0_size", "ask_0_size", "mid", "microprice")) + ")",
    "crossed_or_locked": hit_sql("bid_0_price>=ask_0_price"),
    "ladder_not_monotone": f"({hit_sql('bid_0_price<=bid_1_price')} OR {hit_sql('ask_0_price>=ask_1_price')})",
    "read_after_event": hit_sql("target_read_ts>t_event"),
    "mid_mismatch": hit_sql("mid<>(bid_0_price+ask_0_price)/2.0::DOUBLE"),
}
COSTS = ("half_spread_bps", "latency_drift_bps", "slippage_bps", "cost_bps")
STAGES_SQL = " UNION ALL ".join(
    [
        rules_sql("bars", "(SELECT * REPLACE (CASE WHEN n_trades%5=2 THEN -threshold ELSE threshold END AS threshold, CASE WHEN n_trades%7=3 THEN t_event+1 ELSE max_received END AS max_received, CASE WHEN n_trades%4=1 THEN 'other' ELSE close_reason END AS close_reason, CASE WHEN n_trades%6=5 THEN NULL ELSE cap_fire END AS cap_fire) FROM decisions_v)", {
            "bad_threshold": bad_sql("threshold"),
            "close_before_start": hit_sql("coalesce(cap_fire,last_origin)<interval_start"),
            "received_after_event": hit_sql("max_received>t_event"),
            "unknown_reason": "close_reason NOT IN ('threshold','time_cap','day_end')",
            "threshold_not_reached": hit_sql("close_reason='threshold' AND notional<threshold"),
            "cap_without_fire": "close_reason='time_cap' AND cap_fire IS NULL",
        }),
        rules_sql("reads", "(SELECT * REPLACE (CASE WHEN bid_depth%3=1 THEN ask_0_price ELSE bid_0_price END AS bid_0_price, CASE WHEN ask_depth%4=2 THEN t_event+1 ELSE target_read_ts END AS target_read_ts, CASE WHEN bid_depth%5=4 THEN 0 ELSE ask_0_size END AS ask_0_size) FROM reads_v)", {n: f"(reason IS NULL AND {c})" for n, c in READ_SQL.items()}),
        rules_sql("costs", "(SELECT * REPLACE (CASE WHEN n_trades%3=0 THEN 'nan'::DOUBLE ELSE cost_bps END AS cost_bps, CASE WHEN n_trades%4=0 THEN -1 ELSE slippage_bps END AS slippage_bps) FROM cand_v)", {f"bad_{c}": f"(drop_reason IS NULL AND {bad_sql(c, '<0')})" for c in COSTS}),
        rules_sql("path", "(SELECT *, lag(ts) OVER (PARTITION BY symbol, seg ORDER BY ts) p FROM (SELECT symbol, seg, ts, CASE WHEN (ts//1000000)%11=0 THEN 0 ELSE mid END mid FROM spath_v UNION ALL SELECT symbol, seg, ts, mid FROM spath_v WHERE (ts//1000000)%13=0))", {"bad_mid": bad_sql("mid"), "not_increasing": hit_sql("ts<=p")}),
        rules_sql("spans", "(SELECT * REPLACE (CASE WHEN n_trades%5=0 THEN t_event ELSE t_barrier END AS t_barrier, CASE WHEN n_trades%3=1 THEN t_event+1 WHEN n_trades%3=2 AND n_trades%2=0 THEN NULL ELSE t_feature_start END AS t_feature_start) FROM rows_v)", {
            "empty_span": f"(drop_reason IS NULL AND {hit_sql('t_barrier<=t_event')})",
            "negative_lookback": f"(drop_reason IS NULL AND {hit_sql('t_feature_start>t_event')})",
            "null_time": "(drop_reason IS NULL AND (t_event IS NULL OR t_barrier IS NULL OR t_feature_start IS NULL))",
        }),
    ]
)


def swap(df, **new: tuple[str, object]):
    """Columns replaced where a condition holds."""
    return df.withColumns({c: F.when(F.expr(where), F.expr(value)).otherwise(F.col(c)) for c, (where, value) in new.items()})


@query("check_stage_inputs", sql(STAGES_SQL, "decisions_v", "reads_v", "cand_v", "spath_v", "rows_v"))
def check_stage_inputs(t: Tables):
    """Every stage table of the matrix build with planted breaches, each rule counted by the job that stores the table."""
    b, checks = build(t), StageChecks()
    live = F.col("drop_reason").isNull()
    checks.store("bars", swap(b.bars, threshold=("n_trades % 5 = 2", "-threshold"), max_received=("n_trades % 7 = 3", "t_event + 1"), close_reason=("n_trades % 4 = 1", "'other'"), cap_fire=("n_trades % 6 = 5", "cast(null as bigint)")), K.bar_rules())
    checks.store("reads", swap(b.reads, bid_0_price=("bid_depth % 3 = 1", "ask_0_price"), target_read_ts=("ask_depth % 4 = 2", "t_event + 1"), ask_0_size=("bid_depth % 5 = 4", "0d")), K.read_rules(2))
    costs = swap(b.candidates, cost_bps=("n_trades % 3 = 0", "double('nan')"), slippage_bps=("n_trades % 4 = 0", "-1d"))
    checks.store("costs", costs, {n: live & c for n, c in K.cost_rules().items()})
    path = swap(b.path, mid=("(ts div 1000000) % 11 = 0", "0d")).unionByName(b.path.where("(ts div 1000000) % 13 = 0"))
    checks.store("path", K.with_previous(path, ["symbol", "seg"]), K.path_rules())
    spans = swap(b.rows, t_barrier=("n_trades % 5 = 0", "t_event"), t_feature_start=("n_trades % 3 = 1 or n_trades % 3 = 2 and n_trades % 2 = 0", "if(n_trades % 3 = 1, t_event + 1, null)"))
    checks.store("spans", spans, {n: live & c for n, c in K.span_rules().items()})
    return checks.table(t.spark)
