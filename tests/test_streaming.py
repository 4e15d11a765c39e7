"""Streams give the same rows however their input is cut, and the rows of the batch operators."""

import pytest
from pyspark.sql import functions as F

from lobspark.operators import bars as B
from lobspark.plans import queries_stream as S
from lobspark.streaming.stateful import stream_book_at_trades, stream_dollar_bars

PATH = "/root/testdata/sf0.001/events.parquet"


def cut(spark, folder, n):
    """The events as n files, earliest first, and a stream that reads one file per trigger."""
    events = spark.read.parquet(PATH)
    last = events.agg(F.max("event_id")).first()[0]
    for i in range(n):
        part = events.where(f"event_id > {last * i // n - (i == 0)} AND event_id <= {last * (i + 1) // n}")
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def batch_bars(spark):
    x = S.priced(spark.read.parquet(PATH)).withColumns(
        {"dt": F.to_date(F.timestamp_micros(F.expr("day_ns div 1000L"))), "origin_ns": F.col("ts"), "received_ns": F.col("ts"), "side": F.lit("buy")}
    )
    days = x.select("symbol", "dt").distinct().withColumns({"threshold": F.lit(S.BAR_THRESHOLD), "is_warmup": F.lit(False)})
    closed = B.tagged_bars(x, days, S.BAR_CAP_NS).where("close_reason IS NOT NULL")
    return rows(closed.select("symbol", "bar_idx", "interval_start", "close_reason", "cap_fire", F.round("notional", 6)))


@pytest.mark.parametrize("n", [1, 16])
def test_bars_do_not_depend_on_micro_batches(spark, tmp_path, batch_bars, n):
    events, stream = cut(spark, tmp_path / "in", n)
    out = S.bar_stream(S.priced(stream), events)
    assert rows(out.select("symbol", "bar_idx", "interval_start", "close_reason", "cap_fire", F.round("notional", 6))) == batch_bars
    assert out.agg(F.max("late_count")).first()[0] == 0


def test_book_does_not_depend_on_micro_batches(spark, tmp_path):
    found = []
    for n in (1, 4):
        events, stream = cut(spark, tmp_path / f"in{n}", n)
        found.append(rows(S.book_stream(S.market(stream), events)))
    assert found[0] == found[1] and found[0]


def test_bars_of_a_symbol_fed_after_another(spark, tmp_path):
    """One symbol's later days come in earlier micro-batches than all of the other's."""
    day = 86_400 * 10**9
    kinds = "symbol string, day_ns long, ts long, kind long, seq long, arrival long, price double, quantity double"
    make = lambda symbol, days: [(symbol, d * day, d * day + i * 10**12, 1, i, i, 100.0, 90.0) for d in days for i in range(1, 40)]
    parts = [make("A", [20000, 20005]), make("A", [20010]), make("B", [20000]), make("B", [20001])]
    ends = spark.createDataFrame(sorted({(r[0], r[1], r[1] + day + 1_000_000) for p in parts for r in p}), "symbol string, day_ns long, ts long")
    found = []
    for name, files in (("one", [sum(parts, [])]), ("many", parts)):
        for n, part in enumerate(files):
            spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        found.append(rows(S.drain(stream, ends, lambda d: S.stream_dollar_bars(d, threshold=27_000.0, cap_ns=S.BAR_CAP_NS, watermark_ns=S.WM_NS))))
    assert found[0] == found[1] and {r[0] for r in found[0]} == {"A", "B"}


MARKET = "symbol string, ts long, kind long, seq long, arrival long, side string, tick long, amount double"


def test_a_batch_writes_its_changes_and_not_the_book(spark, tmp_path):
    second = 10**9
    levels = [("A", second * (1 + i), 0, i, i, "bid" if i % 2 else "ask", 1000 - i if i % 2 else 2000 + i, 1.0) for i in range(1500)]
    one = [("A", second * 4000, 0, 5000, 5000, "bid", 999, 3.0), ("A", second * 4010, 0, 5001, 5001, "bid", 997, 2.0)]
    for part in (levels, one):
        spark.createDataFrame(part, MARKET).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(MARKET).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_book_at_trades(stream, k=1, watermark_ns=second).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    updated = [p["stateOperators"][0]["customMetrics"]["rocksdbPutCount"] for p in q.recentProgress if p["numInputRows"]]
    assert updated[0] > 1400 and updated[1] < 10


def test_an_idle_day_ends_by_a_timer(spark, tmp_path):
    day = 20000 * 86_400 * 10**9
    rows_ = [("A", day, day + i * 10**12, 1, i, i, 100.0, 90.0) for i in range(1, 20)]
    kinds = "symbol string, day_ns long, ts long, kind long, seq long, arrival long, price double, quantity double"
    spark.createDataFrame(rows_, kinds).coalesce(1).write.parquet(str(tmp_path / "in"))
    bars = stream_dollar_bars(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")), threshold=27_000.0, cap_ns=S.BAR_CAP_NS, watermark_ns=S.WM_NS, idle_ms=300)
    q = bars.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            found = spark.read.schema(bars.schema).parquet(str(tmp_path / "out")) if (tmp_path / "out").exists() else None
            if found is not None and found.where("close_reason = 'day_end' or cap_fire is not null").count():
                break
    finally:
        q.stop()
    assert found.count() > 10 and found.agg(F.max("interval_start")).first()[0] > day + 19 * 10**12
