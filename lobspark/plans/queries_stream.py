"""Streaming queries: the events file as a stream, ended by a control stream, results kept as a table."""

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.plans import queries_bars  # noqa: F401  (its recursion is reused below)
from lobspark.plans.common import r
from lobspark.plans.queries_book import LEVELS
from lobspark.plans.registry import query
from lobspark.plans.tables import FRAGMENTS, Tables, sql
from lobspark.session import DAY_NS, HOUR_NS, _shared_folder
from lobspark.streaming.stateful import FLUSH, stream_book_at_trades, stream_dollar_bars

WM_NS = 1_000_000_000
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BAR_THRESHOLD, BAR_CAP_NS = 27_000.0, 2 * HOUR_NS


def drain(data: DataFrame, ends: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``build(data)`` over all that the stream holds, then end every key of ``ends``, and return the output as a table.

    The ends come through a second source that stays empty until the first run is over, so no key ends before its
    last event, whatever the micro-batches are.
    """
    spark = data.sparkSession
    base = f"{_shared_folder(spark)}/lobspark-{uuid.uuid4().hex}"
    spark.createDataFrame([], data.schema).write.parquet(f"{base}/ends")
    stream = build(data.unionByName(spark.readStream.schema(data.schema).parquet(f"{base}/ends")))

    def run() -> None:
        before = spark.conf.get(BATCH)
        spark.conf.set(BATCH, "8m")  # packed rows are large; a stream keeps the settings it was started with
        try:
            query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        finally:
            spark.conf.set(BATCH, before)
        query.awaitTermination()

    run()
    # no nulls in BIGINT columns: pandas would turn them into floats
    known = {f.name: F.lit(0 if f.dataType.simpleString() == "bigint" else None).cast(f.dataType) for f in data.schema}
    known |= {"kind": F.lit(FLUSH).cast("bigint")} | {c: F.col(c) for c in ends.columns}
    ends.select(*[known[f.name].alias(f.name) for f in data.schema]).write.mode("append").parquet(f"{base}/ends")
    run()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def mapped(events: DataFrame) -> DataFrame:
    ts = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return events.select("event_id", "event_type", "user_id", "value", ts.alias("ns"), F.concat(F.lit("S"), (F.col("user_id") % 2).cast("string")).alias("symbol"))


def source(t: Tables) -> DataFrame:
    return t.spark.readStream.schema(t.raw("events").schema).parquet(f"{t.path}/event[s].parquet")


def market(events: DataFrame, arrival: str = "event_id") -> DataFrame:
    """Deltas and trades in one stream."""
    trade = F.col("event_type").isin("purchase", "signup")
    bid = (F.col("event_type") == "view") | ((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0))
    buy = F.col("event_type") == "purchase"
    tick = 10000 + (1 + F.col("user_id") % 10) * F.when(bid, -1).otherwise(1)
    return mapped(events).select(
        "symbol", F.col("ns").alias("ts"), F.when(trade, 1).otherwise(0).cast("bigint").alias("kind"), F.col("event_id").alias("seq"), F.expr(arrival).cast("bigint").alias("arrival"),
        F.when(trade, F.when(buy, "buy").otherwise("sell")).otherwise(F.when(bid, "bid").otherwise("ask")).alias("side"),
        tick.cast("bigint").alias("tick"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("amount"),
    )


def priced(events: DataFrame) -> DataFrame:
    """Trades of every symbol-day."""
    e = mapped(events).filter(F.col("event_type").isin("purchase", "signup"))
    return e.select(
        "symbol", F.expr(f"(ns div {DAY_NS}L) * {DAY_NS}L").alias("day_ns"), F.col("ns").alias("ts"), F.lit(1).cast("bigint").alias("kind"), F.col("event_id").alias("seq"), F.col("event_id").alias("arrival"),
        (F.lit(100.0) + (F.col("event_id") % 21 - 10) / 100.0).alias("price"), F.col("value").alias("quantity"),
    )


def book_stream(data: DataFrame, events: DataFrame, k: int = 2) -> DataFrame:
    """Book at trades over a stream ``data`` of ``market`` rows; ``events`` is the same input as a table."""
    return drain(data, mapped(events).select("symbol").distinct(), lambda d: stream_book_at_trades(d, k=k, watermark_ns=WM_NS))


def bar_stream(data: DataFrame, events: DataFrame) -> DataFrame:
    """Bars over a stream ``data`` of ``priced`` rows; ``events`` is the same input as a table."""
    days = priced(events).select("symbol", "day_ns").distinct().withColumn("ts", F.col("day_ns") + DAY_NS + 1_000_000)
    return drain(data, days, lambda d: stream_dollar_bars(d, threshold=BAR_THRESHOLD, cap_ns=BAR_CAP_NS, watermark_ns=WM_NS))


@query(
    "stream_book_at_trades",
    sql("SELECT t.symbol, t.origin_ns ts, t.seq, t.side, t.quantity amount, 0::BIGINT late_count, " + ", ".join(LEVELS) + " FROM book_at_trades_v b JOIN trades_v t USING (symbol, origin_ns)", "book_at_trades_v", "trades_v"),
)
def book_at_trades(t: Tables):
    return book_stream(market(source(t)), t.raw("events"))


# the bar recursion over every symbol-day of the priced trades, with one threshold
FRAGMENTS["sbt_v"] = (
    (),
    """SELECT *, row_number() OVER (PARTITION BY symbol, dt ORDER BY origin_ns, seq) rn FROM (
         SELECT 'S'||(user_id%2) symbol, CAST(CAST(ts AS TIMESTAMP) AS DATE) dt, epoch_us(CAST(ts AS TIMESTAMP))*1000 origin_ns, event_id seq, 100.0::DOUBLE+(event_id%21-10)/100.0::DOUBLE price, value quantity
         FROM events WHERE event_type IN ('purchase','signup'))""",
)
FRAGMENTS["ssched_v"] = (("sbt_v",), f"SELECT DISTINCT symbol, dt, {BAR_THRESHOLD}::DOUBLE threshold, false is_warmup FROM sbt_v")
for _name in ("clock_v", "bar_close_v"):
    _deps, _text = FRAGMENTS[_name]
    for _old in ("sched_v", "bt_v", "clock_v"):
        _text = re.sub(rf"\b{_old}\b", f"s{_old}", _text)
    FRAGMENTS[f"s{_name}"] = (tuple(f"s{d}" for d in _deps), _text)


@query(
    "stream_dollar_bars",
    sql(f"SELECT symbol, (epoch_us(dt::TIMESTAMP)*1000//{DAY_NS})*{DAY_NS} day_ns, bar_idx, interval_start, close_reason, cap_fire, round(notional,4)+0.0 notional, 0::BIGINT late_count FROM sbar_close_v", "sbar_close_v"),
)
def dollar_bars(t: Tables):
    return bar_stream(priced(source(t)), t.raw("events")).withColumn("notional", r("notional", 4))


@query(
    "late_event_count",
    """WITH e AS (SELECT 'S' || (user_id % 2) symbol, epoch_us(CAST(ts AS TIMESTAMP)) * 1000 ns, event_type IN ('purchase', 'signup') trade, event_id * 2 + CASE WHEN event_id % 97 = 0 THEN 81 ELSE 0 END arrival FROM events),
         l AS (SELECT *, coalesce(ns <= max(ns) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1000000000, false) late FROM e),
         c AS (SELECT *, sum(late::INT) OVER (PARTITION BY symbol ORDER BY arrival) n FROM l)
       SELECT symbol, max(n)::BIGINT late_count, count(*) n_trades FROM c WHERE trade AND NOT late GROUP BY 1""",
)
def late_event_count(t: Tables):
    """Every 97th event arrives forty events late."""
    arrival = "event_id * 2 + CASE WHEN event_id % 97 = 0 THEN 81 ELSE 0 END"
    out = book_stream(market(source(t), arrival), t.raw("events"), k=1)
    return out.groupBy("symbol").agg(F.max("late_count").alias("late_count"), F.count("*").alias("n_trades"))
