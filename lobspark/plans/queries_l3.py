"""Order-level (L3) queries over order lines."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lobspark.operators import book as B
from lobspark.operators import l3
from lobspark.operators.ordered import dealt
from lobspark.operators.quality import frame_quality
from lobspark.plans.common import r
from lobspark.plans.registry import query
from lobspark.plans.tables import FRAGMENTS, Tables, sql, topk_fragment
from lobspark.session import HOUR_NS, materialize

BIG = 1_000_000_000_000
H = HOUR_NS
D0 = 1_704_067_200_000_000_000
FRAGMENTS["l3_v"] = (
    (),
    f"""SELECT rn*{BIG}+l_orderkey seq, l_orderkey order_id, 'S'||((l_orderkey//2)%2)::VARCHAR symbol, DATE '2024-01-01' dt,
       CASE WHEN rn=1 AND l_orderkey%11<>0 THEN CASE WHEN l_orderkey%13=0 THEN 'SNAPSHOT' ELSE 'ADD' END WHEN l_returnflag='A' THEN 'MATCH' WHEN l_returnflag='N' THEN 'SUB'
            WHEN l_suppkey%5=0 THEN 'SET' WHEN l_suppkey%5=1 THEN 'NOTE' ELSE 'DELETE' END update_type,
       CASE WHEN l_orderkey%2=0 THEN 'bid' ELSE 'ask' END side, 10000+(1+l_orderkey%20)*(CASE WHEN l_orderkey%2=0 THEN -1 ELSE 1 END) tick, l_quantity size,
       (rn*{H}+(l_orderkey%1000)*3600000000)%86400000000000 time_exchange_ns
       FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) rn FROM lineitem)""",
)
# the same life written order by order, as a recursion over each order's events
FRAGMENTS["l3seq_v"] = (("l3_v",), "SELECT *, row_number() OVER (PARTITION BY symbol, order_id ORDER BY seq) k FROM l3_v")
FRAGMENTS["life_v"] = (
    ("l3seq_v",),
    """/*rec*/ SELECT symbol, order_id, 0::BIGINT k, 0::BIGINT seq, ''::VARCHAR update_type, 0.0::DOUBLE bsize, 0::BIGINT btick, ''::VARCHAR bside, 0.0::DOUBLE asize, 0::BIGINT atick, ''::VARCHAR aside FROM l3seq_v WHERE k=1
       UNION ALL SELECT e.symbol, e.order_id, e.k, e.seq, e.update_type, l.asize, l.atick, l.aside,
         CASE WHEN e.update_type IN ('ADD','SET','SNAPSHOT') THEN e.size WHEN e.update_type='DELETE' THEN 0 WHEN e.update_type IN ('SUB','MATCH') THEN CASE WHEN l.asize-e.size<=1e-9 THEN 0 ELSE l.asize-e.size END ELSE l.asize END,
         CASE WHEN e.update_type IN ('ADD','SET','SNAPSHOT') THEN e.tick ELSE l.atick END, CASE WHEN e.update_type IN ('ADD','SET','SNAPSHOT') THEN e.side ELSE l.aside END
       FROM life_v l JOIN l3seq_v e ON e.symbol=l.symbol AND e.order_id=l.order_id AND e.k=l.k+1""",
)
FRAGMENTS["l2_v"] = (
    ("life_v",),
    """SELECT symbol, seq, side, tick, CASE WHEN s>1e-9 THEN s ELSE 0 END size FROM (SELECT symbol, seq, side, tick, sum(d) OVER (PARTITION BY symbol, side, tick ORDER BY seq) s FROM (
         SELECT symbol, seq, side, tick, sum(d) d FROM (SELECT symbol, seq, bside side, btick tick, -bsize d FROM life_v WHERE k>0 AND bsize>0 UNION ALL SELECT symbol, seq, aside, atick, asize FROM life_v WHERE k>0 AND asize>0)
         GROUP BY 1,2,3,4 HAVING sum(d)<>0))""",
)
FRAGMENTS["l3time_v"] = (
    ("l3_v",),
    f"""SELECT *, max(CASE WHEN update_type='SNAPSHOT' THEN {D0} ELSE {D0}+time_exchange_ns END) OVER (PARTITION BY symbol, dt ORDER BY seq) label_ns,
         CASE WHEN update_type='SNAPSHOT' THEN {D0} ELSE {D0}+time_exchange_ns END raw_ns FROM l3_v""",
)
FRAGMENTS["l2time_v"] = (("l2_v", "l3time_v"), "SELECT l.*, t.label_ns, t.label_ns origin_ns FROM l2_v l JOIN l3time_v t USING (symbol, seq)")
FRAGMENTS["l3grid_v"] = ((), f"SELECT symbol, {D0}+h*{H} sample_ts FROM (SELECT unnest(['S0','S1']) symbol), (SELECT unnest(range(24)) h)")
FRAGMENTS["l3top_v"] = (("l2time_v", "l3grid_v"), topk_fragment("l2time_v", grid="l3grid_v"))


def events(t: Tables):
    li = dealt(t.raw("lineitem"), "l_orderkey")  # orders never leave their partition again
    k = F.col("l_orderkey")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rn = F.col("rn")
    sup = F.col("l_suppkey") % 5
    kind = (
        F.when((rn == 1) & (k % 11 != 0), F.when(k % 13 == 0, "SNAPSHOT").otherwise("ADD"))
        .when(F.col("l_returnflag") == "A", "MATCH")
        .when(F.col("l_returnflag") == "N", "SUB")
        .when(sup == 0, "SET")
        .when(sup == 1, "NOTE")
        .otherwise("DELETE")
    )
    return li.withColumn("rn", F.row_number().over(w).cast("bigint")).select(
        (rn * BIG + k).alias("seq"), k.alias("order_id"), F.concat(F.lit("S"), (F.expr("l_orderkey div 2") % 2).cast("string")).alias("symbol"),
        F.to_date(F.lit("2024-01-01")).alias("dt"), kind.alias("update_type"), F.when(k % 2 == 0, "bid").otherwise("ask").alias("side"),
        (10000 + (1 + k % 20) * F.when(k % 2 == 0, -1).otherwise(1)).cast("bigint").alias("tick"), F.col("l_quantity").alias("size"),
        ((rn * H + (k % 1000) * 3_600_000_000) % (24 * H)).alias("time_exchange_ns"),
    )


W_SEQ = l3.SEQ_WIDTH  # buckets of orders: a wider one would hold all rows of a line number


def l2_timed(t: Tables):
    ev = events(t)
    life = materialize(l3.order_lifecycle(ev))
    l2 = l3.l3_to_l2(life, W_SEQ)
    lt = l3.label_times(life, W_SEQ).select("symbol", "seq", "label_ns")
    n = life.count()
    return dealt(l2, "symbol", "seq", rows=2 * n).join(dealt(lt, "symbol", "seq", rows=2 * n), ["symbol", "seq"])


@query("scan_l3_orders", sql("SELECT symbol, update_type, count(*) n, min(seq) first_seq, max(seq) last_seq, round(sum(size),2)+0.0 total FROM l3_v GROUP BY 1,2", "l3_v"))
def scan_l3_orders(t: Tables):
    return events(t).groupBy("symbol", "update_type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), r(F.sum("size"), 2).alias("total"))


@query("l3_order_lifecycle", sql("SELECT symbol, order_id, seq, bsize before, asize after FROM life_v WHERE k>0", "life_v"))
def l3_order_lifecycle(t: Tables):
    return l3.order_lifecycle(events(t)).select("symbol", "order_id", "seq", "before", "after")


@query(
    "l3_lifecycle_counters",
    sql(
        """SELECT symbol, update_type, count(*) n, count(*) FILTER (WHERE update_type IN ('SUB','MATCH','DELETE') AND bsize=0) missing_order, count(*) FILTER (WHERE update_type='ADD' AND bsize>0) add_existing,
             count(*) FILTER (WHERE update_type='SET' AND bsize=0) set_missing, count(*) FILTER (WHERE update_type='NOTE') unknown_type FROM life_v WHERE k>0 GROUP BY 1,2""",
        "life_v",
    ),
)
def l3_lifecycle_counters(t: Tables):
    return l3.lifecycle_counters(l3.order_lifecycle(events(t)))


@query("l3_to_l2", sql("SELECT symbol, seq, side, tick, size FROM l2_v", "l2_v"))
def l3_to_l2(t: Tables):
    return l3.l3_to_l2(materialize(l3.order_lifecycle(events(t))), W_SEQ)


@query("l3_label_time", sql("SELECT symbol, dt, count(*) n, count(*) FILTER (WHERE raw_ns<label_ns) time_regressions, max(label_ns) last_label, count(DISTINCT label_ns) n_labels FROM l3time_v GROUP BY 1,2", "l3time_v"))
def l3_label_time(t: Tables):
    x = l3.label_times(events(t), W_SEQ)
    return x.groupBy("symbol", "dt").agg(F.count("*").alias("n"), F.count_if("regressed").alias("time_regressions"), F.max("label_ns").alias("last_label"), F.count_distinct("label_ns").alias("n_labels"))


TOP = ["bid_0_price", "bid_0_size", "ask_0_price", "ask_0_size", "bid_1_price", "ask_1_price", "bid_depth", "ask_depth"]


def l3_top(t: Tables):
    l2 = materialize(l2_timed(t).withColumnRenamed("label_ns", "origin_ns"))
    syms = l2.select("symbol").distinct()
    g = B.grid(syms.withColumn("dt", F.to_date(F.lit("2024-01-01"))), H)
    return B.book_asof(l2, g, k=2, width=6 * H)


@query("l3_book_asof_grid", sql("SELECT symbol, sample_ts, " + ", ".join(TOP) + " FROM l3top_v", "l3top_v"))
def l3_book_asof_grid(t: Tables):
    return l3_top(t).select("symbol", "sample_ts", *TOP)


@query(
    "l3_book_quality",
    sql("SELECT symbol, count(*) n_samples, count(*) FILTER (WHERE bid_0_price>=ask_0_price) crossed_samples, count(*) FILTER (WHERE bid_0_price IS NULL OR ask_0_price IS NULL) missing_book_samples FROM l3top_v GROUP BY 1", "l3top_v"),
)
def l3_book_quality(t: Tables):
    return frame_quality(l3_top(t), ["symbol"]).select("symbol", "n_samples", "crossed_samples", "missing_book_samples")


AT = D0 + 3 * H


@query("l3_snapshot_at", sql(f"SELECT * FROM (SELECT symbol, side, tick, arg_max(size, seq) size FROM l2time_v WHERE label_ns<={AT} GROUP BY 1,2,3) WHERE size>0", "l2time_v"))
def l3_snapshot_at(t: Tables):
    return l3.snapshot_at(l2_timed(t), F.lit(AT))
