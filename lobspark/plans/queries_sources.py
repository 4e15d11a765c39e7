"""Scans, normalization and sinks over the market views."""

from pyspark.sql import functions as F

from lobspark.functions import normalize as N
from lobspark.operators import book as B
from lobspark.operators.ordered import rank
from lobspark.plans.common import r
from lobspark.plans.queries_trades import feed
from lobspark.plans.registry import query
from lobspark.plans.tables import FRAGMENTS, GRID_NS, Tables, sql
from lobspark.sources import scans as S


def long_sql(rules: dict[str, str], src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' rule, count(*) FILTER (WHERE coalesce({c}, true)) n FROM {src}" for n, c in rules.items()
    )


TRADE_RULES = {
    "origin_not_absolute": "origin_ns < 1000000000000000000",
    "received_before_origin": "received_ns < origin_ns",
    "bad_price": "price <= 0",
    "bad_quantity": "quantity <= 0",
    "bad_side": "side NOT IN ('buy','sell')",
}
ANY_BAD = " OR ".join(f"coalesce({c}, true)" for c in TRADE_RULES.values())


@query("scan_trades", sql(f"SELECT venue, dt, origin_ns, received_ns, seq, side, price, quantity FROM feed_v WHERE NOT ({ANY_BAD})", "feed_v"))
def scan_trades(t: Tables):
    return S.scan_trades(feed(t)).select("venue", "dt", "origin_ns", "received_ns", "seq", "side", "price", "quantity")


@query("scan_trades_violations", sql(long_sql(TRADE_RULES, "feed_v"), "feed_v"))
def scan_trades_violations(t: Tables):
    f = feed(t)
    return S.violations(f, S.trade_rules(f))


@query(
    "scan_book_deltas",
    sql(
        """SELECT symbol, count(*) n_rows, count(*) FILTER (WHERE row(origin_ns, seq) < p) n_out_of_order FROM (
             SELECT *, lag(row(origin_ns, seq)) OVER (PARTITION BY symbol ORDER BY received_ns) p FROM deltas_v) GROUP BY 1""",
        "deltas_v",
    ),
)
def scan_book_deltas(t: Tables):
    d = t.deltas.withColumn("pos", F.col("received_ns"))
    return S.order_violations(d, ["symbol"], "pos", ["origin_ns", "seq"], pos_width=86_400_000_000_000)


@query(
    "scan_day_bounded",
    sql(
        """SELECT venue, dt, count(*) n_rows, count(*) FILTER (WHERE NOT coalesce(o>=0 AND o<86400000000000, false)) n_off_day FROM (
           SELECT venue, dt, origin_ns-epoch_us(cast(dt AS timestamp))*1000 o FROM feed_v) GROUP BY 1,2""",
        "feed_v",
    ),
)
def scan_day_bounded(t: Tables):
    ok = F.coalesce(S.in_day(), F.lit(False))
    return feed(t).groupBy("venue", "dt").agg(F.count("*").alias("n_rows"), F.count_if(~ok).alias("n_off_day"))


# snapshot ladders derived from the sample grid: crossed, one-sided, thin and bad-size cases planted
FRAGMENTS["snap_levels_v"] = (
    ("grid_v",),
    f"""SELECT * FROM (SELECT symbol, dt, sample_ts, i lvl, side,
         10000+2*(day(dt)%3) + CASE WHEN side='bid' THEN CASE WHEN h%7=0 THEN 2-i ELSE -1-i END ELSE 1+i END tick,
         CASE WHEN side='bid' AND i=2 AND h%17=0 THEN 0.0 ELSE 5.0 END size, h
       FROM (SELECT *, sample_ts//{GRID_NS} h FROM grid_v), (SELECT unnest(range(5)) i), (SELECT unnest(['bid','ask']) side))
       WHERE NOT (side='ask' AND h%11=0) AND NOT (lvl>0 AND h%13=0)""",
)


def snapshots_wide(t: Tables):
    h = F.expr(f"sample_ts div {GRID_NS}L")
    center = F.lit(10000) + 2 * (F.dayofmonth("dt") % 3)
    df = t.grid
    cols = {}
    for i in range(5):
        gone = (h % 13 == 0) if i else F.lit(False)
        bid = center + F.when(h % 7 == 0, 2 - i).otherwise(-1 - i)
        cols[f"bid_{i}_price"] = F.when(~gone, bid / 100.0)
        cols[f"bid_{i}_size"] = F.when(~gone, F.when((h % 17 == 0) & F.lit(i == 2), 0.0).otherwise(5.0))
        cols[f"ask_{i}_price"] = F.when(~(gone | (h % 11 == 0)), (center + 1 + i) / 100.0)
        cols[f"ask_{i}_size"] = F.when(~(gone | (h % 11 == 0)), F.lit(5.0))
    return df.withColumns(cols)


def snapshots(t: Tables):
    """``symbol, dt, sample_ts, bids, asks`` as ladders of (px, sz)."""
    return S.ladders(snapshots_wide(t), 5, ["symbol", "dt", "sample_ts"])


def snapshot_levels(t: Tables):
    s = snapshots(t)
    one = lambda c: s.select("symbol", "dt", "sample_ts", F.lit(c[:-1]).alias("side"), F.posexplode(c).alias("lvl", "x"))
    return (
        one("bids")
        .unionByName(one("asks"))
        .select("symbol", "dt", "sample_ts", "side", "lvl", F.round(F.col("x.px") * 100).cast("bigint").alias("tick"), F.col("x.sz").alias("size"))
    )


@query(
    "scan_snapshots_wide",
    sql("SELECT symbol, sample_ts, side, row_number() OVER (PARTITION BY symbol, sample_ts, side ORDER BY lvl)-1 lvl, tick, size FROM snap_levels_v", "snap_levels_v"),
)
def scan_snapshots_wide(t: Tables):
    return snapshot_levels(t).select("symbol", "sample_ts", "side", F.col("lvl").cast("bigint").alias("lvl"), "tick", "size")


@query(
    "scan_seeded_day",
    sql(
        """SELECT symbol, dt, origin_ns, kind, side, tick, size, row_number() OVER (PARTITION BY symbol, dt ORDER BY origin_ns, kind, seq) pos FROM (
             SELECT symbol, dt, sample_ts origin_ns, 0::BIGINT kind, lvl*2+(side='ask')::INT seq, side, tick, size FROM snap_levels_v
             WHERE sample_ts = epoch_us(cast(dt AS timestamp))*1000
             UNION ALL SELECT symbol, dt, origin_ns, 1, seq, side, tick, size FROM deltas_v)""",
        "snap_levels_v",
        "deltas_v",
    ),
)
def scan_seeded_day(t: Tables):
    sl = snapshot_levels(t).select(
        "symbol", "dt", F.col("sample_ts").alias("origin_ns"),
        (F.col("lvl") * 2 + (F.col("side") == "ask").cast("int")).cast("bigint").alias("seq"), "side", "tick", "size",
    )
    day = S.seeded_day(sl, t.deltas)
    return rank(day, ["symbol", "dt"], ["origin_ns", "kind", "seq"], name="pos").drop("seq")


@query(
    "thin_snapshots",
    sql(
        """WITH RECURSIVE p AS (SELECT DISTINCT symbol, dt, origin_ns ts FROM deltas_v),
           k AS (SELECT symbol, dt, min(ts) ts FROM p GROUP BY 1,2
             UNION ALL SELECT k.symbol, k.dt, (SELECT min(p.ts) FROM p WHERE p.symbol=k.symbol AND p.dt=k.dt AND p.ts>=k.ts+7200000000000) ts
             FROM k WHERE k.ts IS NOT NULL)
           SELECT symbol, dt, ts origin_ns FROM k WHERE ts IS NOT NULL""",
        "deltas_v",
    ),
)
def thin_snapshots(t: Tables):
    return S.thin_snapshots(t.deltas, ["symbol", "dt"], "origin_ns", 7_200_000_000_000)


@query("sample_grid", sql("SELECT symbol, dt, sample_ts FROM grid_v", "grid_v"))
def sample_grid(t: Tables):
    return B.grid(t.days, GRID_NS)


RAW = """SELECT symbol, dt, seq pos, origin_ns "timestamp", received_ns receipt_timestamp, price, quantity amount,
   CASE seq%4 WHEN 0 THEN upper(side) WHEN 1 THEN left(side,1) WHEN 2 THEN side ELSE upper(side)||'_ESTIMATED' END side, seq id FROM trades_v"""
FRAGMENTS["raw_v"] = (("trades_v",), RAW)
SIDE_SQL = "CASE WHEN lower(side)='b' OR lower(side) LIKE 'buy%' THEN 'buy' WHEN lower(side)='s' OR lower(side) LIKE 'sell%' THEN 'sell' END"


def raw_trades(t: Tables):
    s, side = F.col("seq") % 4, F.col("side")
    return t.trades.select(
        "symbol", "dt", F.col("seq").alias("pos"), F.col("origin_ns").alias("timestamp"),
        F.col("received_ns").alias("receipt_timestamp"), "price", F.col("quantity").alias("amount"),
        F.when(s == 0, F.upper(side)).when(s == 1, F.left(side, F.lit(1))).when(s == 2, side)
        .otherwise(F.concat(F.upper(side), F.lit("_ESTIMATED"))).alias("side"),
        F.col("seq").alias("id"),
    )


@query(
    "normalize_trades",
    sql(f'SELECT symbol, "timestamp" origin_ns, receipt_timestamp received_ns, price, amount quantity, {SIDE_SQL} side, id trade_id FROM raw_v', "raw_v"),
)
def normalize_trades(t: Tables):
    return N.normalize_trades(raw_trades(t), ["symbol"])


@query("normalize_side", sql(f"SELECT side raw_side, {SIDE_SQL} side, count(*) n FROM raw_v GROUP BY 1,2", "raw_v"))
def normalize_side(t: Tables):
    x = raw_trades(t).select(F.col("side").alias("raw_side"), N.side_of(F.col("side")).alias("side"))
    return x.groupBy("raw_side", "side").agg(F.count("*").alias("n"))


@query("normalize_funding", sql('SELECT symbol, "timestamp" origin_ns, receipt_timestamp received_ns, (price-100)/1000 funding_rate, "timestamp"+28800000000000 next_funding_time FROM raw_v', "raw_v"))
def normalize_funding(t: Tables):
    x = raw_trades(t).withColumns({"rate": (F.col("price") - 100) / 1000, "next_funding_time": F.col("timestamp") + 28_800_000_000_000})
    return N.normalize_funding(x, ["symbol"])


@query("normalize_open_interest", sql('SELECT symbol, "timestamp" origin_ns, receipt_timestamp received_ns, amount*10 open_interest FROM raw_v', "raw_v"))
def normalize_open_interest(t: Tables):
    return N.normalize_open_interest(raw_trades(t).withColumn("oi", F.col("amount") * 10), ["symbol"])


@query("normalize_liquidations", sql(f'SELECT symbol, "timestamp" origin_ns, receipt_timestamp received_ns, price, amount quantity, {SIDE_SQL} side FROM raw_v', "raw_v"))
def normalize_liquidations(t: Tables):
    return N.normalize_liquidations(raw_trades(t), ["symbol"])


@query(
    "normalize_feed_table",
    sql(
        """SELECT venue, dt, CASE WHEN o=1 THEN 'origin' WHEN r=1 THEN 'received' WHEN o>0.99 THEN 'origin' WHEN r>0.99 THEN 'received' END axis,
             n_rows, n_dropped, n_resorted FROM (
           SELECT venue, dt, any_value(o) o, any_value(r) r, count(*) n_rows,
             count(*) FILTER (WHERE coalesce(e,0)<=0) n_dropped FROM (SELECT *, CASE WHEN o=1 OR (r<1 AND o>0.99) THEN origin_ns ELSE received_ns END e FROM f JOIN w USING (venue, dt)) GROUP BY 1,2)
           JOIN (SELECT venue, dt, count(*) FILTER (WHERE e < p) n_resorted FROM (
               SELECT *, lag(e) OVER (PARTITION BY venue, dt ORDER BY pos) p FROM (SELECT *, CASE WHEN o=1 OR (r<1 AND o>0.99) THEN origin_ns ELSE received_ns END e FROM f JOIN w USING (venue, dt)) WHERE e>0) GROUP BY 1,2) USING (venue, dt)""",
        "feed_v",
    ).replace(
        "\nSELECT venue, dt, CASE WHEN o=1",
        """,
        f AS (SELECT * FROM feed_v WHERE price IS NOT NULL AND side <> 'unknown'),
        w AS (SELECT venue, dt, avg((coalesce(origin_ns,0)>0)::INT) o, avg((coalesce(received_ns,0)>0)::INT) r FROM f GROUP BY 1,2)
SELECT venue, dt, CASE WHEN o=1""",
        1,
    ),
)
def normalize_feed_table(t: Tables):
    raw = feed(t).filter("price IS NOT NULL AND side <> 'unknown'").withColumnsRenamed({"origin_ns": "origin_time", "received_ns": "received_time"})
    _, summary = S.normalize_feed(raw, N.normalize_trades, ["venue", "dt"])
    return summary.withColumn("n_resorted", F.coalesce("n_resorted", F.lit(0)))


@query(
    "vendor_time_to_ns",
    sql(
        """SELECT symbol, seq, origin_ns - epoch_us(cast(dt AS timestamp))*1000 + seq%10*100 tod_ns,
             origin_ns - epoch_us(cast(dt AS timestamp))*1000 + seq%10*100 iso_ns FROM trades_v""",
        "trades_v",
    ),
)
def vendor_time_to_ns(t: Tables):
    us = F.timestamp_micros(F.expr("origin_ns div 1000"))
    digit = (F.col("seq") % 10).cast("string")
    x = t.trades.select(
        "symbol", "seq", "dt",
        F.concat(F.date_format(us, "HH:mm:ss.SSSSSS"), digit).alias("tod"),
        F.concat(F.date_format(us, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), digit).alias("iso"),
    )
    return x.select("symbol", "seq", N.vendor_time_ns(F.col("tod"), B.day_open()).alias("tod_ns"), N.vendor_time_ns(F.col("iso"), B.day_open()).alias("iso_ns"))


@query(
    "normalize_epoch",
    sql(
        """SELECT symbol, cast(CASE symbol WHEN 'S0' THEN 1000000 ELSE 1000000000 END AS bigint) multiplier, count(*) n,
             min(CASE symbol WHEN 'S0' THEN origin_ns//1000000*1000000 ELSE origin_ns//1000000000*1000000000 END) first_ns,
             max(CASE symbol WHEN 'S0' THEN origin_ns//1000000*1000000 ELSE origin_ns//1000000000*1000000000 END) last_ns FROM trades_v GROUP BY 1""",
        "trades_v",
    ),
)
def normalize_epoch(t: Tables):
    raw = t.trades.select("symbol", F.when(F.col("symbol") == "S0", F.expr("origin_ns div 1000000L")).otherwise(F.expr("origin_ns div 1000000000L")).alias("ts"))
    out = S.normalize_epoch(raw, ["symbol"], "ts")
    return out.groupBy("symbol", "multiplier").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


@query(
    "to_ticks",
    sql(
        """SELECT seq, cast(tick AS bigint) ticks, CASE WHEN tick%10=0 THEN cast(tick//10 AS bigint) END coarse_ticks,
             cast(CASE WHEN tick%100=0 THEN 0 WHEN tick%10=0 THEN 1 ELSE 2 END AS bigint) decimals FROM trades_v""",
        "trades_v",
    ),
)
def to_ticks(t: Tables):
    text = F.format_string("%d.%02d00", F.expr("tick div 100"), F.col("tick") % 100)
    x = t.trades.select("seq", text.alias("s"))
    return x.select("seq", N.to_ticks(F.col("s"), 100).alias("ticks"), N.to_ticks(F.col("s"), 10).alias("coarse_ticks"), N.decimal_places(F.col("s")).alias("decimals"))


@query(
    "measure_tick_scale",
    sql("SELECT symbol, count(*) n_prices, count(*) FILTER (WHERE tick%10<>0) off_tick_at_expected, 2::BIGINT measured_decimals, 100::BIGINT conformance_scale FROM trades_v GROUP BY 1", "trades_v"),
)
def measure_tick_scale(t: Tables):
    return S.measure_tick_scale(t.trades, ["symbol"], F.col("price"), expected_decimals=1)


@query(
    "select_engine_time",
    sql(
        """SELECT 'received' axis, src, count(*) n_rows, count(*) FILTER (WHERE coalesce(received_ns,0)<=0) n_dropped FROM (
             SELECT 'a' src, received_ns FROM feed_v WHERE coalesce(received_ns,0)>0 UNION ALL SELECT 'b', received_ns FROM deltas_v) GROUP BY 1,2""",
        "feed_v",
        "deltas_v",
    ),
)
def select_engine_time(t: Tables):
    a = feed(t).filter(F.col("received_ns").isNotNull()).select(F.lit("a").alias("src"), "origin_ns", "received_ns")
    b = t.deltas.select(F.lit("b").alias("src"), "origin_ns", "received_ns")
    return S.select_engine_time(a.unionByName(b), "src")[0]


@query(
    "spread_regime",
    sql("SELECT symbol, sample_ts, CASE WHEN round((ask_0_price-bid_0_price)/0.01)<=3 THEN 'tight' ELSE 'wide' END regime FROM topk_a WHERE bid_0_price < ask_0_price", "topk_a"),
)
def spread_regime(t: Tables):
    tick = F.round((F.col("ask_0_price") - F.col("bid_0_price")) / 0.01)
    return t.topk_a.filter("bid_0_price < ask_0_price").select("symbol", "sample_ts", N.spread_regime(tick, 3.0).alias("regime"))


@query("log_return_target", sql("SELECT symbol, seq, round(1e4*ln(1+(price-100)/100),6)+0.0 y_log_bps FROM trades_v", "trades_v"))
def log_return_target(t: Tables):
    simple = (F.col("price") - 100) / 100 * 1e4
    return t.trades.select("symbol", "seq", r(N.log_return_bps(simple)).alias("y_log_bps"))
