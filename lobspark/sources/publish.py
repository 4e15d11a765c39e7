"""Tables whose contract is counted while they are written: stage checks and a sink that publishes only sound output."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lobspark.session import materialize


class ContractBreach(ValueError):
    """Rules that rows broke; ``counts`` lists ``(stage, rule, n)``."""

    def __init__(self, counts: Sequence[tuple[str, str, int]]):
        super().__init__("; ".join(f"{stage}: {rule} {n}" for stage, rule, n in counts))
        self.counts = list(counts)


def _hits(rules: Mapping[str, Column]) -> list[Column]:
    """As in ``violations``: a rule that cannot be told (null) counts as broken."""
    return [F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()]


class StageChecks:
    """Rules of several stage tables, each counted by the job that writes its table.

    A task that runs again can count a breach twice, never hide one: zero means that no written row broke a rule.
    """

    def __init__(self) -> None:
        self.counts: list[tuple[str, str, int]] = []

    def store(self, stage: str, df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
        """``materialize(df)`` with the rules counted on the way; columns of ``df`` named ``__…`` serve rules only and are not written."""
        seen = Observation(f"{stage}-{uuid.uuid4().hex}")
        watched = df.observe(seen, F.count(F.lit(1)).alias("__rows"), *_hits(rules))
        out = materialize(watched.drop(*[c for c in df.columns if c.startswith("__")]))
        self.counts += [(stage, rule, int(seen.get[rule])) for rule in rules]
        return out

    def broken(self) -> list[tuple[str, str, int]]:
        return [c for c in self.counts if c[2]]

    def table(self, spark: SparkSession) -> DataFrame:
        """``stage, rule, n`` of all rules counted so far."""
        return spark.createDataFrame(self.counts, "stage string, rule string, n long")


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str, *, keys: Sequence[str], rules: Mapping[str, Column], columns: Sequence[str] | None = None, partitions: Sequence[str] = (),
            checks: StageChecks | None = None, max_records_per_file: int = 20_000_000) -> int:
    """Write ``columns`` in that order to ``path`` and return the number of rows, if every row keeps the rules and the keys are unique.

    Rows are ranged on ``(partitions, keys)`` and sorted, so equal keys lie beside each other in one task and files are in key order; rules
    and repeated keys are counted in the tasks that write. The files stand in a staging folder beside ``path`` until all counts, and those of
    ``checks``, are zero; one rename publishes them. Otherwise the staging folder goes and ``ContractBreach`` tells the counts.

    Defined cases: a breach of an earlier stage stops before any write; an existing ``path`` is refused, never replaced; null keys are equal to each
    other; an empty table is published without rows; missing or repeated ``columns`` fail before any job.
    """
    spark, columns = df.sparkSession, list(columns or df.columns)
    missing = [c for c in [*columns, *keys, *partitions] if c not in df.columns]
    twice = sorted({c for c in columns if columns.count(c) > 1})
    unwritten = [c for c in [*keys, *partitions] if c not in columns]
    if missing or twice or unwritten:
        raise ValueError(f"columns missing {missing}, repeated {twice}, keys or partitions not written {unwritten}")
    if checks is not None and checks.broken():
        raise ContractBreach(checks.broken())
    fs, final = _folder(spark, path)
    if fs.exists(final):
        raise FileExistsError(path)
    place = list(dict.fromkeys([*partitions, *keys]))
    same = W.partitionBy(*place).orderBy(*place)
    # rules may read columns that are not written
    ranged = df.repartitionByRange(*place).withColumn("__again", F.row_number().over(same) > 1).sortWithinPartitions(*place)
    seen = Observation(f"publish-{uuid.uuid4().hex}")
    watched = ranged.observe(seen, F.count(F.lit(1)).alias("__rows"), *_hits({**rules, "repeated_key": F.col("__again")}))
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    watched.select(*columns).write.option("compression", "zstd").option("maxRecordsPerFile", max_records_per_file).partitionBy(*partitions).parquet(staging)
    counts = [("publish", rule, int(seen.get[rule])) for rule in (*rules, "repeated_key")]
    _, staged = _folder(spark, staging)
    if any(n for _, _, n in counts):
        fs.delete(staged, True)
        raise ContractBreach([c for c in counts if c[2]])
    if fs.exists(final) or not fs.rename(staged, final):
        fs.delete(staged, True)
        raise FileExistsError(path)
    return int(seen.get["__rows"])
