"""Contract-checked scans, stream assembly and sinks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobspark.functions.normalize import epoch_multiplier, vendor_time_ns
from lobspark.operators.book import day_open
from lobspark.operators.folds import ordered_fold
from lobspark.operators.ordered import shift
from lobspark.operators.stats import quantiles
from lobspark.session import DAY_NS

MIN_ABSOLUTE_NS = 1_000_000_000_000_000_000  # below this a clock is a time of day, not an epoch


def violations(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Long table of rule violation counts: one aggregation, ``rule, n`` (per ``by`` group)."""
    counted = df.groupBy(*by).agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])
    return counted.select(*by, F.explode(pairs).alias("x")).select(*by, "x.rule", "x.n")


def bad_number(c: Column, positive: bool = True) -> Column:
    low = (c <= 0) if positive else (c < 0)
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | low


def scan_trades(df: DataFrame, day: Column | None = None) -> DataFrame:
    """Valid normalized trades: absolute clocks, received not before origin, positive numbers."""
    ok = ~trade_rules_any(df)
    out = df.filter(ok)
    return out.filter(F.col("dt") == day) if day is not None else out


def trade_rules(df: DataFrame) -> dict[str, Column]:
    return {
        "origin_not_absolute": F.col("origin_ns") < MIN_ABSOLUTE_NS,
        "received_before_origin": F.col("received_ns") < F.col("origin_ns"),
        "bad_price": bad_number(F.col("price")),
        "bad_quantity": bad_number(F.col("quantity")),
        "bad_side": ~F.col("side").isin("buy", "sell"),
    }


def trade_rules_any(df: DataFrame) -> Column:
    out = F.lit(False)
    for c in trade_rules(df).values():
        out = out | F.coalesce(c, F.lit(True))
    return out


def delta_rules() -> dict[str, Column]:
    return {
        "origin_not_absolute": F.col("origin_ns") < MIN_ABSOLUTE_NS,
        "received_before_origin": F.col("received_ns") < F.col("origin_ns"),
        "bad_price": F.col("tick") <= 0,
        "bad_size": bad_number(F.col("size"), positive=False),
        "bad_side": ~F.col("side").isin("bid", "ask"),
    }


def order_violations(df: DataFrame, keys: Sequence[str], pos: str, key: Sequence[str], pos_width: int = 1_000_000) -> DataFrame:
    """Rows that step back in ``key`` order relative to the row before in input position."""
    k = F.struct(*key)
    rows = shift(df, keys, [pos], {"__prev": k}, width=pos_width)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("__prev").isNotNull() & (k < F.col("__prev"))).alias("n_out_of_order")
    )


def in_day(ts: str = "origin_ns", dt: str = "dt") -> Column:
    off = F.col(ts) - day_open(dt)
    return (off >= 0) & (off < DAY_NS)


def seeded_day(snapshot_levels: DataFrame, deltas: DataFrame) -> DataFrame:
    """Snapshot level rows (state at or before the day open) in front of the day's deltas."""
    cols = ["symbol", "dt", "origin_ns", "seq", "side", "tick", "size"]
    s = snapshot_levels.filter(F.col("origin_ns") <= day_open()).select(*cols, F.lit(0).cast("bigint").alias("kind"))
    return s.unionByName(deltas.select(*cols, F.lit(1).cast("bigint").alias("kind")))


def ladders(df: DataFrame, max_levels: int, keep: Sequence[str]) -> DataFrame:
    """Wide level columns to arrays of ``(px, sz)``; a level without finite price and size is padding."""

    def side(name: str) -> Column:
        cells = [
            F.struct(
                F.col(f"{name}_{i}_price").cast("double").alias("px"), F.col(f"{name}_{i}_size").cast("double").alias("sz")
            )
            for i in range(max_levels)
        ]

        def fin(c: Column) -> Column:
            return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

        kept = F.filter(F.array(*cells), lambda x: fin(x["px"]) & fin(x["sz"]))
        asc = F.array_sort(kept)
        return F.reverse(asc) if name == "bid" else asc

    return df.select(*keep, side("bid").alias("bids"), side("ask").alias("asks"))


class _Thin:
    def __init__(self, stride: int):
        self.stride, self.last = stride, None

    def push(self, pdf):
        import numpy as np

        ts = pdf["ts"].to_numpy()
        keep, i = [], 0
        if self.last is not None:
            i = int(np.searchsorted(ts, self.last + self.stride, side="left"))
        while i < len(ts):
            keep.append(i)
            self.last = int(ts[i])
            i = int(np.searchsorted(ts, self.last + self.stride, side="left"))
        return pdf.iloc[keep][["ts"]].reset_index(drop=True)

    def finish(self):
        return None


def thin_snapshots(df: DataFrame, keys: Sequence[str], ts: str, stride_ns: int) -> DataFrame:
    """Greedy thinning per key: keep the first time, then the first at least ``stride_ns`` later."""
    types = dict(df.dtypes)
    ddl = "".join(f"{k} {types[k]}, " for k in keys) + "ts bigint"
    src = df.select(*keys, F.col(ts).alias("ts")).distinct()
    out = ordered_fold(src, keys, ["ts"], lambda key: _Thin(stride_ns), ddl)
    return out.withColumnRenamed("ts", ts)


def select_engine_time(df: DataFrame, source: str, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """One clock populated in every input (``source`` column): origin, else received, else best >99 %.

    Returns ``(choice, rows)``: the chosen axis with dropped-row counts per source, and the rows with
    ``engine_ns`` set, unpopulated ones dropped.
    """
    keys = list(keys)
    pop = lambda c: F.avg((F.coalesce(F.col(c), F.lit(0)) > 0).cast("double"))
    per = df.groupBy(*keys, source).agg(pop("origin_ns").alias("o"), pop("received_ns").alias("r"))
    worst = per.groupBy(*keys).agg(F.min("o").alias("o"), F.min("r").alias("r"))
    choice = worst.select(
        *keys,
        F.when(F.col("o") == 1, "origin")
        .when(F.col("r") == 1, "received")
        .when(F.col("o") > 0.99, "origin")
        .when(F.col("r") > 0.99, "received")
        .alias("axis"),
    )
    joined = df.join(choice, keys) if keys else df.crossJoin(F.broadcast(choice))  # one row: bounded
    rows = joined.withColumn("engine_ns", F.when(F.col("axis") == "origin", F.col("origin_ns")).otherwise(F.col("received_ns")))
    dropped = rows.groupBy(*keys, source, "axis").agg(
        F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.col("engine_ns"), F.lit(0)) <= 0).alias("n_dropped")
    )
    return dropped, rows.filter(F.col("engine_ns") > 0)


def normalize_epoch(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Bring an epoch column of unknown unit to nanoseconds, one decision per key (one file, feed…)."""
    med = quantiles(df.filter(F.col(col) > 0), keys, {"v": F.col(col)}, {"median": 0.5})
    return (
        df.join(med, list(keys), "left")
        .withColumn("multiplier", epoch_multiplier(F.col("v_median")))
        .withColumn(f"{col}_ns", F.col(col) * F.col("multiplier"))
        .drop("v_median")
    )


def measure_tick_scale(df: DataFrame, keys: Sequence[str], price: Column, expected_decimals: int, max_decimals: int = 4) -> DataFrame:
    """Smallest number of decimals at which every price is integral, and off-tick counts."""

    def err(d: int) -> Column:
        s = float(10**d)
        return F.abs(price * s - F.rint(price * s))

    aggs = [F.max(err(d)).alias(f"e{d}") for d in range(max_decimals + 1)]
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n_prices"), F.count_if(err(expected_decimals) > 1e-6).alias("off_tick_at_expected"), *aggs
    )
    measured = F.lit(None).cast("bigint")
    for d in reversed(range(max_decimals + 1)):
        measured = F.when(F.col(f"e{d}") <= 1e-6, F.lit(d).cast("bigint")).otherwise(measured)
    return out.select(*keys, "n_prices", "off_tick_at_expected", measured.alias("measured_decimals")).withColumn(
        "conformance_scale", F.pow(F.lit(10.0), F.greatest("measured_decimals", F.lit(expected_decimals))).cast("bigint")
    )


# ------------------------------------------------------------------ files
L3_CSV = T.StructType(
    [
        T.StructField("time_exchange", T.StringType()),
        T.StructField("time_received", T.StringType()),
        T.StructField("update_type", T.StringType()),
        T.StructField("is_buy", T.IntegerType()),
        T.StructField("entry_px", T.DoubleType()),
        T.StructField("entry_sx", T.DoubleType()),
        T.StructField("order_id", T.StringType()),
    ]
)
TRADES_CSV = T.StructType(
    [
        T.StructField("time_exchange", T.StringType()),
        T.StructField("time_received", T.StringType()),
        T.StructField("guid", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("base_amount", T.DoubleType()),
        T.StructField("taker_side", T.StringType()),
    ]
)


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of every file block; a task reads blocks one after the other, so it holds no more than a batch."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        files, starts = b["file"], b["b"]
        new = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(starts[1:], starts[:-1]))
        at = [0, *(pc.indices_nonzero(new).to_numpy() + 1).tolist()]
        if last == (files[0].as_py(), starts[0].as_py()):
            at = at[1:]
        last = (files[-1].as_py(), starts[-1].as_py())
        if at:
            yield b.take(pa.array(at))


def _scan_csv(spark: SparkSession, path: str, schema: T.StructType, mixed: bool = False) -> DataFrame:
    """Semicolon CSV (plain or gzip) whose header must carry the schema's columns in any order.

    All files have the first one's header, else the scan fails; with ``mixed`` each file is read by its own, for which the lines are read
    once more, and there is one scan per order of columns.

    ``seq`` is the file order: an unsplittable gzip file is one partition, so the id Spark assigns
    grows in file order inside it, and ``file`` tells files apart.
    """
    if mixed:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("b"))
        heads = lines.mapInArrow(_first_lines, lines.schema).groupBy("file").agg(F.min_by("value", "b").alias("head")).groupBy("head").agg(F.collect_list("file").alias("files"))
        layouts = [(r["head"].split(";"), r["files"]) for r in heads.collect()]  # one row per order of columns
        if not layouts:
            raise ValueError(f"{path}: no rows")
    else:
        layouts = [(spark.read.option("sep", ";").option("header", True).csv(path).columns, path)]
    by_name = {f.name: f for f in schema}
    out = None
    for head, files in layouts:
        missing = [c for c in by_name if c not in head]
        if missing:
            raise ValueError(f"{files}: header lacks {missing}; it has {head}")
        full = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in head])
        # every file's own header is compared with the schema: a file with another column order fails, it is not misread
        raw = spark.read.option("sep", ";").option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(full).csv(files)
        raw = raw.select(F.monotonically_increasing_id().alias("seq"), F.input_file_name().alias("file"), *by_name)
        out = raw if out is None else out.unionByName(raw)
    return out


def scan_l3_csv(spark: SparkSession, path: str, day: str, mixed: bool = False) -> DataFrame:
    raw = _scan_csv(spark, path, L3_CSV, mixed)
    open_ns = day_open_lit(day)
    return raw.select(
        "seq",
        "file",
        vendor_time_ns(F.col("time_exchange"), open_ns).alias("time_exchange_ns"),
        vendor_time_ns(F.col("time_received"), open_ns).alias("time_received_ns"),
        "update_type",
        (F.col("is_buy") == 1).alias("is_buy"),
        "entry_px",
        "entry_sx",
        "order_id",
    )


def scan_trades_csv(spark: SparkSession, path: str, day: str, mixed: bool = False) -> DataFrame:
    from lobspark.functions.normalize import strict_side

    raw = _scan_csv(spark, path, TRADES_CSV, mixed)
    open_ns = day_open_lit(day)
    return raw.select(
        "seq",
        "file",
        (open_ns + vendor_time_ns(F.col("time_exchange"), open_ns)).alias("origin_ns"),
        (open_ns + vendor_time_ns(F.col("time_received"), open_ns)).alias("received_ns"),
        "price",
        F.col("base_amount").alias("quantity"),
        strict_side(F.col("taker_side")).alias("side"),
        F.coalesce("guid", F.lit("")).alias("trade_id"),
        "taker_side",
    )


def day_open_lit(day: str) -> Column:
    return F.unix_micros(F.to_date(F.lit(day)).cast("timestamp")) * 1000


def write_hive(df: DataFrame, path: str, order: Sequence[str], partitions: Sequence[str] = ("exchange", "symbol", "dt"),
               max_records_per_file: int = 20_000_000) -> None:
    """ZSTD Parquet by partition columns, rows sorted inside files; only the written days are replaced.

    Partitions are range-shuffled on ``(partition columns, order)``: a hot symbol-day spreads over
    several files instead of one task.
    """
    (
        df.repartitionByRange(*partitions, *order)
        .sortWithinPartitions(*partitions, *order)
        .write.option("compression", "zstd")
        .option("maxRecordsPerFile", max_records_per_file)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .mode("overwrite")
        .parquet(path)
    )


def scan_hive(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def normalize_feed(raw: DataFrame, normalizer, keys: Sequence[str], pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Normalizer, engine-time choice and in-day order for any passthrough feed.

    Returns the rows and one summary row per key with dropped and out-of-place row counts. Rows of one position stand in
    the order of their time, so that none of them is out of place for another and the count does not depend on the run.
    """
    rows = normalizer(raw, [*keys, pos])
    keys = list(keys)
    dropped, clean = select_engine_time(rows.withColumn("__src", F.lit("feed")), "__src", keys)
    moved = shift(clean, keys, [pos, "engine_ns"], {"__prev": F.col("engine_ns")}, width=1_000_000)
    n_moved = moved.groupBy(*keys).agg(F.count_if(F.col("engine_ns") < F.col("__prev")).alias("n_resorted"))
    summary = dropped.drop("__src").join(n_moved, keys, "left")
    return clean.drop("__src", "axis"), summary


