"""Order-level events to level-2 books.

An order's size between two state-defining events is a base minus a running sum, so its life is
plain window arithmetic; levels are running sums of the resulting size changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lobspark.operators.book import day_open
from lobspark.operators.ordered import dealt, running, shift

EPS = 1e-9
SETS = ("SNAPSHOT", "ADD", "SET")
REDUCES = ("SUB", "MATCH")
SEQ_WIDTH = 1_000_000


def order_lifecycle(events: DataFrame, size_policy: str = "decrement") -> DataFrame:
    """Every event with the order's state before and after, and its quality flags.

    ``events``: symbol, seq, order_id, update_type, side, tick, size. A set opens an epoch; inside it
    reducing events subtract (``decrement``) or restate (``absolute``) until the order is gone.
    """
    if size_policy not in ("absolute", "decrement"):
        raise ValueError("size_policy must be absolute or decrement")
    order = W.partitionBy("symbol", "order_id").orderBy("seq")
    is_set, is_red, is_del = F.col("update_type").isin(*SETS), F.col("update_type").isin(*REDUCES), F.col("update_type") == "DELETE"
    known = is_set | is_red | is_del
    x = events.withColumn("epoch", F.sum(is_set.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    ep = W.partitionBy("symbol", "order_id", "epoch").orderBy("seq")
    upto = ep.rowsBetween(W.unboundedPreceding, 0)
    base = F.first(F.when(is_set, F.struct("side", "tick", "size")), ignorenulls=True).over(upto)
    x = x.withColumn("base", base)
    if size_policy == "decrement":
        taken = F.sum(F.when(is_red, F.col("size")).otherwise(0.0)).over(upto)
        rest = F.col("base.size") - taken
        x = x.withColumn("rest", rest)
        x = x.withColumn("gone", F.max((is_del | (F.col("rest") <= EPS)).cast("int")).over(upto) == 1)
        after, tick, side = F.col("rest"), F.col("base.tick"), F.col("base.side")
    else:
        x = x.withColumn("gone", F.max((is_del | ((is_red | is_set) & (F.col("size") <= EPS))).cast("int")).over(upto) == 1)
        cur = F.last(F.when(is_set | is_red, F.struct("side", "tick", "size")), ignorenulls=True).over(upto)
        x = x.withColumn("cur", cur)
        after, tick, side = F.col("cur.size"), F.col("cur.tick"), F.col("cur.side")
    x = x.withColumns(
        {"after": F.when((F.col("epoch") > 0) & ~F.col("gone"), after).otherwise(0.0), "a_tick": F.coalesce(tick, F.col("tick")), "a_side": F.coalesce(side, F.col("side"))}
    )
    prev = F.lag(F.struct("after", "a_tick", "a_side")).over(order)
    x = x.withColumn("prev", prev).withColumn("before", F.coalesce("prev.after", F.lit(0.0)))
    alive = F.col("before") > EPS
    return x.withColumns(
        {
            "missing_order": (is_red | is_del) & ~alive,
            "add_existing": (F.col("update_type") == "ADD") & alive,
            "set_missing": (F.col("update_type") == "SET") & ~alive,
            "unknown_type": ~known,
        }
    )


def lifecycle_counters(life: DataFrame) -> DataFrame:
    return life.groupBy("symbol", "update_type").agg(
        F.count("*").alias("n"),
        *[F.count_if(c).alias(c) for c in ("missing_order", "add_existing", "set_missing", "unknown_type")],
    )


def level_changes(life: DataFrame, rows: int | None = None) -> DataFrame:
    """Signed size changes per level: ``symbol, seq, side, tick, delta``; ``rows``: about how many they are."""
    out = life.filter(F.col("before") > EPS).select("symbol", "seq", F.lit(0).alias("sub"), F.col("prev.a_side").alias("side"), F.col("prev.a_tick").alias("tick"), (-F.col("before")).alias("delta"))
    into = life.filter(F.col("after") > EPS).select("symbol", "seq", F.lit(1).alias("sub"), F.col("a_side").alias("side"), F.col("a_tick").alias("tick"), F.col("after").alias("delta"))
    both = dealt(out.unionByName(into), "symbol", "seq", "side", "tick", rows=rows) if rows is not None else out.unionByName(into)
    return both.groupBy("symbol", "seq", "side", "tick").agg(F.sum("delta").alias("delta")).filter("delta <> 0")


def l3_to_l2(life: DataFrame, width: int = SEQ_WIDTH) -> DataFrame:
    """Absolute level sizes after every change, 0 where a level empties (a level-2 delta stream)."""
    n = 2 * life.count()  # a change leaves one level and enters one
    x = running(level_changes(life, n), ["symbol", "side", "tick"], ["seq"], {"__s": ("sum", F.col("delta"))}, width=width, rows=n)
    return x.select("symbol", "seq", "side", "tick", F.when(F.col("__s") > EPS, F.col("__s")).otherwise(0.0).alias("size"))


def label_times(events: DataFrame, width: int = SEQ_WIDTH) -> DataFrame:
    """Non-decreasing label time in ``seq`` order; snapshots are clamped to the day open."""
    raw = F.when(F.col("update_type") == "SNAPSHOT", day_open()).otherwise(day_open() + F.col("time_exchange_ns"))
    x = running(events.withColumn("__raw", raw), ["symbol", "dt"], ["seq"], {"label_ns": ("max", F.col("__raw"))}, width=width, rows=events.count())
    return x.withColumn("regressed", F.col("__raw") < F.col("label_ns")).drop("__raw")


def sequence_checks(events: DataFrame, pos: str, width: int = SEQ_WIDTH) -> DataFrame:
    x = shift(events, ["symbol", "dt"], [pos], {"__p": F.col("seq")}, width=width)
    return x.groupBy("symbol", "dt").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("seq") < F.col("__p")).alias("seq_disorder"), F.count_if(F.col("seq") == F.col("__p")).alias("seq_duplicate")
    )


def snapshot_at(l2: DataFrame, at: Column) -> DataFrame:
    """Full-depth book from level sizes at one label time."""
    return l2.filter(F.col("label_ns") <= at).groupBy("symbol", "side", "tick").agg(F.max_by("size", "seq").alias("size")).filter("size > 0")
