"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

NS_PER_S = 1_000_000_000
HOUR_NS = 3600 * NS_PER_S
DAY_NS = 86_400 * NS_PER_S


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster pass your own session instead."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lobspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOBSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator assumes, applied to whatever session the caller brings."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_scratch: dict[str, str] = {}
_written: list[str] = []


def _shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a fresh local one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _scratch[app]


def materialize(df: DataFrame) -> DataFrame:
    """Store an expensive intermediate as Parquet in the shared folder and read it back.

    Cuts lineage (a lost executor re-reads the table instead of replaying folds) and lets several
    consumers read it column-pruned instead of recomputing it.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/lobspark-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_intermediates(spark: SparkSession) -> int:
    """Delete what ``materialize`` has stored so far. Call it once no result that reads them is needed any more."""
    jvm, n = spark.sparkContext._jvm, len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
