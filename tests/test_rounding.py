"""Outputs are rounded as the SQL rounds them, also halves that binary doubles miss, and the order of tied rows is fixed."""

import duckdb
from pyspark.sql import functions as F

from lobspark.functions import normalize as N
from lobspark.operators.stats import abs_stats
from lobspark.plans.common import r
from lobspark.sources import scans as S


def test_halves_round_as_in_sql(spark):
    values = [(k * 10 + 5) / 10 ** (d + 1) * s for k in range(0, 300_000, 997) for d in (3, 4, 6) for s in (1, -1)]
    values += [0.0, -0.0, 1e17, -1e-9, float("inf"), float("nan"), None]
    x = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(r("v", 3), r("v", 4), r("v", 6))
    sql = duckdb.connect()
    want = [sql.execute("select round(v,3)+0.0, round(v,4)+0.0, round(v,6)+0.0 from (select cast(? as double) v)", [v]).fetchone() for v in values]
    assert [str(tuple(row)) for row in x.collect()] == [str(row) for row in want]


def test_median_between_two_notionals(spark):
    pairs = [(a / 1e4, (a + 1) / 1e4) for a in range(10_000, 400_000, 3_001)]
    rows = [(i, v) for i, p in enumerate(pairs) for v in p]
    s = abs_stats(spark.createDataFrame(rows, "k int, v double"), ["k"], {"v": F.col("v")}).select("k", r("median", 4).alias("m"))
    got = dict(map(tuple, s.collect()))
    sql = duckdb.connect()
    want = {i: sql.execute("select round(quantile_cont(v, 0.5), 4)+0.0 from (select unnest(?::double[]) v)", [list(p)]).fetchone()[0] for i, p in enumerate(pairs)}
    assert got == want


def test_rows_of_one_position_are_not_out_of_place(spark):
    t0 = 1_700_000_000_000_000_000
    rows = [("v", p, t0 + dt, t0 + dt, 1.0, 1.0, "buy", i) for i, (p, dt) in enumerate([(1, 10), (2, 40), (2, 20), (2, 30), (3, 50), (4, 45)])]
    columns = "venue string, pos long, origin_time long, received_time long, price double, quantity double, side string, trade_id long"
    for order in (rows, rows[::-1], sorted(rows, key=lambda x: x[2])):
        _, summary = S.normalize_feed(spark.createDataFrame(order, columns).coalesce(1), N.normalize_trades, ["venue"])
        assert summary.first()["n_resorted"] == 1  # position 4 alone
