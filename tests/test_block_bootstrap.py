"""Block-bootstrap totals against a plain loop over the same draws."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lobspark.operators import evaluate as E


def plain(values: list[float], n_boot: int, block: int, seed: int) -> dict[int, float]:
    n, out = len(values), {}
    for rep in range(n_boot if n >= block else 0):
        total = 0.0
        for j in range(-(-n // block)):
            start = int(hashlib.md5(f"{seed}|{rep}|{j}".encode()).hexdigest()[:12], 16) % n
            total += sum(values[(start + k) % n] for k in range(min(block, n - j * block)))
        out[rep] = total
    return out


@pytest.mark.parametrize(("n", "block"), [(97, 10), (100, 10), (10, 10), (11, 10), (19, 10), (9, 10), (0, 5), (7, 1)])
def test_totals(spark, n, block):
    rng = random.Random(n)
    values = [rng.uniform(-5, 5) for _ in range(n)]
    rows = spark.createDataFrame([(i * 1000, v) for i, v in enumerate(values)], "t long, v double")
    series = E.numbered(rows, ["t"], F.col("v"), 7000)
    got = {r.rep: r.total for r in E.block_bootstrap(series, n_boot=40, block=block, seed=3).collect()}
    assert got == pytest.approx(plain(values, 40, block, 3))


def test_small_values_beside_a_large_one(spark):
    """A huge early value takes no digits from blocks that do not hold it."""
    values = [1e16] + [0.25] * 399
    rows = spark.createDataFrame(list(enumerate(values)), "t long, v double")
    sums = E.moving_block_sums(E.numbered(rows, ["t"], F.col("v"), 50), 400, 4)
    assert {r["full"] for r in sums.filter("start between 8 and 390").collect()} == {1.0}


def test_draws_are_counted_before_the_join(spark):
    """The draws' exchange stands above their partial counts, and no second exchange of single draws follows."""
    series = E.numbered(spark.range(200).selectExpr("id t", "double(id) v"), ["t"], F.col("v"), 1000)
    plan = E.block_bootstrap(series, n_boot=500, block=2, seed=1)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Range (0, 50000")].splitlines()
    kinds = [k for line in reversed(above) for k in ("partial_collect_list", "Exchange") if k in line]
    assert kinds[:2] == ["partial_collect_list", "Exchange"]
