"""Market views derived from the analytics tables, as DataFrames and as SQL fragments."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.operators import book as B
from lobspark.operators.ordered import running
from lobspark.session import HOUR_NS, materialize, prepare

GRID_NS = HOUR_NS


class Tables:
    """Lazy views over one data directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = prepare(spark), path.rstrip("/")
        self._stored: dict[str, DataFrame] = {}

    def stored(self, name: str) -> DataFrame:
        """A view kept as a table because several steps read it."""
        if name not in self._stored:
            self._stored[name] = materialize(getattr(self, name))
        return self._stored[name]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        return self.raw("events").select(
            "event_id",
            "user_id",
            "event_type",
            "value",
            F.concat(F.lit("S"), (F.col("user_id") % 2).cast("string")).alias("symbol"),
            F.to_date(ts).alias("dt"),
            (F.unix_micros(ts) * 1000).alias("origin_ns"),
            (F.unix_micros(ts) * 1000 + (1 + (F.col("event_id") % 7) * 150) * 1_000_000).alias("received_ns"),
            F.dayofmonth(ts).cast("bigint").alias("dom"),
        )

    @cached_property
    def trades(self) -> DataFrame:
        e = self.events.filter(F.col("event_type").isin("purchase", "signup"))
        buy = F.col("event_type") == "purchase"
        e = e.select(
            "symbol",
            "dt",
            "origin_ns",
            "received_ns",
            F.col("event_id").alias("seq"),
            F.when(buy, "buy").otherwise("sell").alias("side"),
            F.col("value").alias("quantity"),
            F.when(buy, 1).otherwise(-1).cast("bigint").alias("__step"),
        )
        e = running(e, ["symbol"], ["origin_ns", "seq"], {"__walk": ("sum", F.col("__step"))})
        return e.select(
            "symbol", "dt", "origin_ns", "received_ns", "seq", "side",
            (F.lit(10000) + F.col("__walk")).cast("bigint").alias("tick"),
            "quantity",
            ((F.lit(10000) + F.col("__walk")) / F.lit(100.0)).alias("price"),
        )

    def _deltas(self, drift: bool) -> DataFrame:
        e = self.events.filter(F.col("event_type").isin("view", "click", "error"))
        bid = (F.col("event_type") == "view") | ((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0))
        off = (1 + F.col("user_id") % 10) * F.when(bid, -1).otherwise(1)
        center = F.lit(10000) + (2 * (F.col("dom") % 3) if drift else F.lit(0))
        return e.select(
            "symbol", "dt", "origin_ns", "received_ns",
            F.col("event_id").alias("seq"),
            F.when(bid, "bid").otherwise("ask").alias("side"),
            (center + off).cast("bigint").alias("tick"),
            F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value")).alias("size"),
        )

    @cached_property
    def deltas(self) -> DataFrame:
        return self._deltas(True)

    @cached_property
    def deltas_clean(self) -> DataFrame:
        return self._deltas(False)

    @cached_property
    def days(self) -> DataFrame:
        return self.events.select("symbol", "dt").distinct()

    @cached_property
    def grid(self) -> DataFrame:
        return B.grid(self.days, GRID_NS)

    @cached_property
    def topk_a(self) -> DataFrame:
        return B.book_asof(self.deltas_clean, self.grid, k=2)

    @cached_property
    def topk_b(self) -> DataFrame:
        return B.book_asof(self.deltas, self.grid, k=2)

    @cached_property
    def quotes(self) -> DataFrame:
        return B.quote_path(self.deltas_clean)

    @cached_property
    def quotes_b(self) -> DataFrame:
        return B.quote_path(self.deltas)

    @cached_property
    def opens(self) -> DataFrame:
        return B.open_points(self.deltas_clean, self.days)

    @cached_property
    def mid_points(self) -> DataFrame:
        return B.mid_path_with_opens(self.stored("quotes"), self.stored("opens"))


# ---------------------------------------------------------------------------- the same views in SQL
_NS = "epoch_us(ts)*1000"
_BID = "(event_type='view' OR (event_type='error' AND event_id%2=0))"


def _deltas_sql(center: str) -> str:
    return f"""
SELECT concat('S', cast(user_id%2 AS varchar)) symbol, cast(ts AS date) dt, {_NS} origin_ns,
       {_NS} + (1+(event_id%7)*150)*1000000 received_ns, event_id seq,
       CASE WHEN {_BID} THEN 'bid' ELSE 'ask' END side,
       cast({center} + (1+user_id%10)*(CASE WHEN {_BID} THEN -1 ELSE 1 END) AS bigint) tick,
       CASE WHEN event_type='error' THEN 0.0 ELSE value END size
FROM events WHERE event_type IN ('view','click','error')"""


def topk_fragment(deltas: str, grid: str = "grid_v", ts: str = "sample_ts", k: int = 2) -> str:
    cols = []
    for side in ("bid", "ask"):
        cols.append(f"count(*) FILTER (WHERE l.side='{side}') {side}_depth")
        for i in range(k):
            f = f"FILTER (WHERE l.side='{side}' AND l.rn={i + 1})"
            cols += [f"max(l.tick) {f} / 100.0::DOUBLE {side}_{i}_price", f"max(l.size) {f} {side}_{i}_size"]
    return f"""
SELECT *, (bid_0_price+ask_0_price)/2.0::DOUBLE mid,
       (ask_0_size*bid_0_price+bid_0_size*ask_0_price)/(bid_0_size+ask_0_size) microprice
FROM (SELECT g.symbol, g.{ts}, {', '.join(cols)}
      FROM {grid} g LEFT JOIN (
        SELECT p.symbol, p.{ts}, v.side, v.tick, v.size,
               row_number() OVER (PARTITION BY p.symbol, p.{ts}, v.side
                                  ORDER BY CASE WHEN v.side='bid' THEN -v.tick ELSE v.tick END) rn
        FROM {grid} p JOIN (
          SELECT *, lead(origin_ns) OVER (PARTITION BY symbol, side, tick ORDER BY origin_ns, seq) nxt
          FROM {deltas}) v
          ON v.symbol=p.symbol AND v.origin_ns<=p.{ts} AND (v.nxt IS NULL OR v.nxt>p.{ts}) AND v.size>0) l
      ON l.symbol=g.symbol AND l.{ts}=g.{ts}
      GROUP BY g.symbol, g.{ts})"""


FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {
    "trades_v": (
        (),
        f"""
SELECT *, tick/100.0::DOUBLE price FROM (
SELECT concat('S', cast(user_id%2 AS varchar)) symbol, cast(ts AS date) dt, {_NS} origin_ns,
       {_NS} + (1+(event_id%7)*150)*1000000 received_ns, event_id seq,
       CASE WHEN event_type='purchase' THEN 'buy' ELSE 'sell' END side,
       cast(10000 + sum(CASE WHEN event_type='purchase' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id%2
               ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) tick,
       value quantity
FROM events WHERE event_type IN ('purchase','signup'))""",
    ),
    "deltas_v": ((), _deltas_sql("10000 + 2*(day(ts)%3)")),
    "deltas_clean_v": ((), _deltas_sql("10000")),
    "days_v": ((), "SELECT DISTINCT concat('S', cast(user_id%2 AS varchar)) symbol, cast(ts AS date) dt FROM events"),
    "grid_v": (
        ("days_v",),
        f"""
SELECT symbol, dt, epoch_us(cast(dt AS timestamp))*1000 + h*{GRID_NS} sample_ts
FROM days_v, (SELECT unnest(range(24)) h)""",
    ),
    "topk_a": (("deltas_clean_v", "grid_v"), topk_fragment("deltas_clean_v")),
    "topk_b": (("deltas_v", "grid_v"), topk_fragment("deltas_v")),
}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """``WITH`` clause over the named fragments (dependencies first) followed by ``body``."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for dep in FRAGMENTS[name][0]:
            visit(dep)
        done.append(name)

    for v in views:
        visit(v)
    ctes = [
        f"{n} AS ({FRAGMENTS[n][1]})" if "/*rec*/" in FRAGMENTS[n][1] else f"{n} AS MATERIALIZED ({FRAGMENTS[n][1].strip()})"
        for n in done
    ]
    recursive = recursive or any("/*rec*/" in FRAGMENTS[n][1] for n in done)
    body = body.strip()
    if not ctes:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE ") :]
    if body.upper().startswith("WITH "):
        return head + ",\n".join(ctes) + ",\n" + body[len("WITH ") :]
    return head + ",\n".join(ctes) + "\n" + body
