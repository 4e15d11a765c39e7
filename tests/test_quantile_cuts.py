"""Exact quantiles although the approximate cuts that place values differ from one evaluation to the next."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lobspark.operators import stats


def test_quantiles_do_not_depend_on_the_cuts(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i % 2, float(rng.randrange(10**6))) for i in range(4000)]
    some = F.udf(lambda v: sorted(random.sample(v, stats.PARTS - 1)), "array<double>")
    monkeypatch.setattr(stats.F, "percentile_approx", lambda c, *_: some(F.collect_list(c)))
    probs = {"median": 0.5, "p95": 0.95, "p99": 0.99, "max": 1.0}
    got = stats.quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], {"v": F.col("v")}, probs)
    for r in got.collect():
        want = np.quantile([v for k, v in rows if k == r.k], list(probs.values()))
        assert np.allclose([r[f"v_{p}"] for p in probs], want, rtol=1e-12)


def test_medians_have_the_bits_of_the_sql(spark):
    rng = random.Random(4)
    pairs = [sorted(rng.randrange(10**9) / 1e6 for _ in range(2)) for _ in range(400)]
    rows = [(i, v) for i, p in enumerate(pairs) for v in p]
    got = {r.k: r.v_m for r in stats.quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], {"v": F.col("v")}, {"m": 0.5}).collect()}
    sql = duckdb.connect()
    assert got == {i: sql.execute("select quantile_cont(v, 0.5) from (select unnest(?::double[]) v)", [p]).fetchone()[0] for i, p in enumerate(pairs)}
