"""Hand fixtures for bars, labels, statistics and contracts, and a sample of queries against DuckDB."""

import importlib
from statistics import NormalDist

import numpy as np
import oracle
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lobspark.functions.normal import norm_cdf, norm_ppf
from lobspark.operators import cv
from lobspark.operators import evaluate as E
from lobspark.operators import labels as L
from lobspark.operators.bars import OpenBar, assign_bars, close_day
from lobspark.operators.contracts import check_matrix
from lobspark.operators.ordered import islands, running
from lobspark.operators.stats import quantiles


def test_bar_clock_threshold_caps_and_residual():
    state, bar, first, closed = assign_bars(OpenBar(0, 0), np.array([10, 20, 120, 130]), np.array([4.0, 6.0, 3.0, 1.0]), 10.0, 100)
    assert closed == [(0, 0, "threshold", None, 10.0), (1, 20, "time_cap", 120, 0.0)]  # at the deadline: next bar
    assert bar.tolist() == [0, 0, 2, 2] and first.tolist() == [True, False, True, False]
    assert close_day(state, 400, 100) == [(2, 120, "time_cap", 220, 4.0), (3, 220, "time_cap", 320, 0.0)]


def test_two_phase_scans_equal_pandas(spark):
    g = np.random.default_rng(0)
    d = pd.DataFrame({"k": g.choice(list("ab"), 300), "ts": g.permutation(300).astype("int64"), "v": g.integers(-3, 4, 300)})
    df = spark.createDataFrame(d)
    out = running(df, ["k"], ["ts"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, width=17).toPandas().sort_values(["k", "ts"])
    w = d.sort_values(["k", "ts"])
    assert (out.s.to_numpy() == w.groupby("k").v.cumsum().to_numpy()).all()
    assert (out.m.to_numpy() == w.groupby("k").v.cummax().to_numpy()).all()
    isl = islands(df, ["k"], ["ts"], [F.col("v") > 0], width=17).toPandas().sort_values(["k", "ts"])
    for k, p in w.groupby("k"):
        f = (p.v > 0).to_numpy()
        want = np.concatenate([[0], np.cumsum(f[1:] != f[:-1])])
        assert (isl[isl.k == k].island.to_numpy() == want).all()


def test_quantiles_equal_numpy(spark):
    v = np.random.default_rng(2).normal(size=500).round(2)
    q = quantiles(spark.createDataFrame(pd.DataFrame({"v": v})), [], {"v": F.col("v")}, {"a": 0.5, "b": 0.95, "c": 0.013}).first()
    assert np.allclose([q.v_a, q.v_b, q.v_c], np.quantile(v, [0.5, 0.95, 0.013]))


def test_triple_barrier_touch_and_vertical(spark):
    path = spark.createDataFrame([("A", t, m) for t, m in [(0, 100.0), (10, 100.5), (20, 101.0), (30, 99.0), (95, 100.2)]], "k string, ts bigint, mid double")
    a = spark.createDataFrame([("A", 0, 100.0, 100.0, "h", 20), ("A", 20, 101.0, 500.0, "h", 50), ("A", 30, 99.0, 50.0, "h", 60)], "k string, t_event bigint, p0 double, width_bps double, horizon string, horizon_ns bigint")
    r = {x.t_event: (x.label, x.t_barrier, round(x.y_fwd_bps, 4)) for x in L.triple_barrier(path, a, ["k"], 64).collect()}
    assert r[0] == (1, 20, 100.0)  # exact touch at the horizon end
    assert r[20] == (0, 70, round((99 - 101) / 101 * 1e4, 4))
    assert r[30] == (0, 90, 0.0)


def test_ewma_is_independent_of_bucket_width(spark):
    g = np.random.default_rng(3)
    p = pd.DataFrame({"k": "A", "ts": np.cumsum(g.integers(1, 50, 200)).astype("int64"), "mid": 100 + np.cumsum(g.normal(size=200)) / 10})
    df = spark.createDataFrame(p)
    out = [L.ewma_vol(df, ["k"], 40, width=w).toPandas().sort_values("ts").vol_bps.to_numpy()[1:] for w in (64 * 40, 120)]
    s = w = 0.0
    want, last = [], None
    for t, m in zip(p.ts, p.mid):
        if last is not None:
            d = 0.5 ** ((t - last[0]) / 40)
            ret = (m - last[1]) / last[1] * 1e4
            s, w = d * s + ret * ret, d * w + 1
            want.append((s / w) ** 0.5)
        last = (t, m)
    assert np.allclose(out[0], want) and np.allclose(out[1], want, rtol=1e-5)


def test_normal_functions(spark):
    n = NormalDist()
    rows = spark.range(1, 500).select((F.col("id") / 500.0).alias("p"), norm_ppf(F.col("id") / 500.0).alias("z")).collect()
    assert max(abs(r.z - n.inv_cdf(r.p)) for r in rows) < 1e-9
    z = spark.range(-40, 41).select((F.col("id") / 5.0).alias("z"), norm_cdf(F.col("id") / 5.0).alias("c")).collect()
    assert max(abs(r.c - n.cdf(r.z)) for r in z) < 1e-12


def test_cpcv_equals_brute_force(spark):
    g = np.random.default_rng(7)
    t = np.sort(g.choice(5000, 120, replace=False)).astype("int64")
    d = pd.DataFrame({"t_event": t, "t_barrier": t + g.integers(1, 200, 120)})
    out = cv.cpcv_splits(spark.createDataFrame(d), n_groups=5, k=2, embargo_ns=90, width=400).toPandas()
    grp = np.arange(120) * 5 // 120
    for split, test in cv.split_table(5, 2):
        sub = out[out.split == split].sort_values("t_event").role.to_numpy()
        is_test = np.isin(grp, test)
        spans = sorted(zip(d.t_event[is_test], d.t_barrier[is_test]))
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        purge = np.zeros(120, bool)
        for lo, hi in merged:
            purge |= ((d.t_event <= hi) & (d.t_barrier >= lo) | (d.t_event > hi) & (d.t_event <= hi + 90)).to_numpy()
        want = np.where(is_test, "test", np.where(purge, "purged", "train"))
        assert (sub == want).all()


def test_contract_fails_on_missing_columns(spark):
    with pytest.raises(ValueError):
        check_matrix(spark.range(3).withColumnRenamed("id", "t_event"), ["x"])


CHECKED = ["normalize_side", "trade_day_metrics", "dollar_bars", "model_matrix", "plan_day_stitch", "l3_to_l2", "pbo", "usable_calendar", "parity_run", "dual_book_reads"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    entry = importlib.import_module("__spark_entry__")
    path = "/root/testdata/sf0.001"
    df = entry.queries()[name](spark, path)
    rows = [tuple(r) for r in df.collect()]
    cur = oracle.connect(path).execute(entry.oracle_sql()[name])
    assert oracle.compare(df.columns, rows, [c[0] for c in cur.description], cur.fetchall()) is None


def test_every_sql_has_a_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bars_do_not_depend_on_how_trades_are_cut():
    rng = np.random.default_rng(3)
    ts, notional = np.sort(rng.integers(0, 5000, 400)), rng.random(400) * 5
    whole = assign_bars(OpenBar(0, 0), ts, notional, 20.0, 90)
    state, closed = OpenBar(0, 0), []
    for part in np.array_split(np.arange(400), 7):
        state, _, _, more = assign_bars(state, ts[part], notional[part], 20.0, 90)
        closed += more
    assert closed == whole[3] and state == whole[0]


def test_ewma_carry_reaches_back_over_all_buckets(spark):
    from lobspark.operators.labels import ewma_vol

    rows = [("a", t * 10, 100.0 if t == 0 else 101.0) for t in range(2000)]  # one early move, then flat
    path = spark.createDataFrame(rows, "symbol string, ts long, mid double")
    got = [ewma_vol(path, ["symbol"], 100, width=w).orderBy("ts").toPandas()["vol_bps"].to_numpy() for w in (400, 6400)]
    assert np.allclose(got[0][1:], got[1][1:], rtol=1e-9, atol=0) and (got[0][1:] > 0).all()


def test_range_join_semi_and_anti_with_nulls(spark):
    from lobspark.operators.ordered import range_join

    p = spark.createDataFrame([("a", 1, 2, None), ("a", 50, 51, None), ("a", 3, 4, 7)], "k string, lo long, hi long, extra long")
    s = spark.createDataFrame([("a", 0, 10)], "k string, s long, e long")
    kw = dict(point_lo="lo", point_hi="hi", span_lo="s", span_hi="e", width=5)
    assert {r["lo"] for r in range_join(p, s, ["k"], how="left_semi", **kw).collect()} == {1, 3}
    assert {r["lo"] for r in range_join(p, s, ["k"], how="left_anti", **kw).collect()} == {50}


def test_book_carries_a_column_named_side(spark):
    from lobspark.operators.book import book_asof

    d = spark.createDataFrame([("a", 1, 1, "bid", 100, 2.0), ("a", 2, 2, "ask", 102, 3.0)], "symbol string, origin_ns long, seq long, side string, tick long, size double")
    q = spark.createDataFrame([("a", 5, "sell")], "symbol string, sample_ts long, side string")
    r = book_asof(d, q, k=1, carry={"side": "string"}).collect()[0]
    assert (r["side"], r["bid_depth"], r["ask_depth"]) == ("sell", 1, 1)


def test_quantiles_of_values_close_together_are_cut_into_many_ranges(spark):
    import numpy as np

    from lobspark.operators.stats import quantiles

    v = 1e9 + np.random.default_rng(3).permutation(5000) * 0.25
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = quantiles(df, [], {"v": F.col("v")}, {"a": 0.0, "b": 0.37, "c": 0.995, "d": 1.0}).first()
    assert np.allclose(list(got), np.quantile(v, [0.0, 0.37, 0.995, 1.0]), rtol=0, atol=1e-6)


def test_first_crossings_match_a_plain_search():
    import numpy as np

    from lobspark.operators.labels import first_hits

    g = np.random.default_rng(5)
    mid = 100 + np.cumsum(g.normal(0, 0.02, 400))
    lo = g.integers(0, 400, 200)
    hi = np.minimum(400, lo + g.integers(0, 90, 200))
    p0, w = mid[np.maximum(lo - 1, 0)], np.where(g.random(200) < 0.1, np.nan, g.uniform(0, 30, 200))
    want = [next((j for j in range(a, b) if abs((mid[j] - p) / p * 1e4) >= x), -1) for a, b, p, x in zip(lo, hi, p0, w)]
    assert first_hits(mid, lo, hi, p0, w).tolist() == want


def test_ridge_keeps_digits_of_large_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1000, 300).astype(float)
    d = pd.DataFrame({"k": 1, "x": 1e13 + x, "y_fwd_bps": 0.25 * x + rng.normal(size=300), "uniqueness": rng.uniform(0.1, 1, 300)})
    got = cv.fit_ridge(spark.createDataFrame(d), ["k"], ["x"]).toPandas().iloc[0]
    w, y = d.uniqueness, d.y_fwd_bps
    cx, cy = x - (w * x).sum() / w.sum(), y - (w * y).sum() / w.sum()
    assert abs(got.b0 - (w * cx * cy).sum() / ((w * cx * cx).sum() + 1)) < 1e-6


def test_groups_of_tied_instants_do_not_depend_on_row_order(spark):
    d = pd.DataFrame({"t_event": [i // 4 for i in range(60)], "t_barrier": [i // 4 + 2 for i in range(60)], "symbol": [f"s{i % 4}" for i in range(60)]})

    def run(frame):
        s = cv.cpcv_splits(spark.createDataFrame(frame).repartition(5), n_groups=7, k=2, embargo_ns=1, keep=["symbol"], width=10)
        return s.orderBy("split", "t_event", "symbol").toPandas()

    pd.testing.assert_frame_equal(run(d), run(d.sample(frac=1, random_state=2)))


def test_blocks_are_numbered_inside_keys(spark):
    d = spark.createDataFrame([(h, t) for h in ("a", "b") for t in range(10)], "horizon string, t_event long")
    got = cv.block_index(d, 4, 3, ["horizon"]).groupBy("horizon", "block").count().toPandas()
    assert sorted(got["count"]) == [2, 2, 2, 2, 3, 3, 3, 3] and set(got.block) == {0, 1, 2, 3}


def test_band_of_no_replicates_is_one_null_row(spark):
    pre = spark.createDataFrame([(1, 1.0), (2, 3.0)], "i long, p double")
    rows = E.bootstrap_band(E.block_bootstrap(pre, n_boot=20, block=50, seed=1), 0.1).collect()
    assert [tuple(r) for r in rows] == [(None, None)]


def test_ridge_rung_equals_models_fitted_on_rows_copied_per_split(spark):
    g = np.random.default_rng(4)
    n = 600
    d = pd.DataFrame({"h": np.where(np.arange(n) % 3 == 0, "a", "b"), "t_event": np.arange(n) * 10, "t_barrier": np.arange(n) * 10 + g.integers(5, 90, n), "x0": g.normal(size=n) + 1e6, "x1": g.normal(size=n), "uniqueness": g.uniform(0.2, 1, n)})
    d["y_fwd_bps"] = d.x1 * 2 + g.normal(size=n)
    rows, cols = spark.createDataFrame(d), ["x0", "x1", "y_fwd_bps", "uniqueness"]
    args = dict(n_groups=5, k=2, keys=["h"])
    s = cv.cpcv_splits(rows, embargo_ns=40, keep=cols, width=1000, **args)
    f = cv.ridge_forecast(s.where("role = 'test'"), cv.fit_ridge(s.where("role = 'train'"), ["h", "split"], ["x0", "x1"]), ["h", "split"], ["x0", "x1"])
    want = cv.collapse_forecasts(f, ["h", "t_event"], 4).toPandas().set_index(["h", "t_event"]).f
    got = cv.ridge_rung(cv.split_groups(rows, embargo_ns=40, keep=cols, width=1000, **args), ["x0", "x1"], **args)
    got = got.toPandas().set_index(["h", "t_event"]).f
    assert len(got) == n and np.allclose(got.sort_index(), want.sort_index(), rtol=1e-6, atol=1e-6)


def test_order_lines_are_dealt_by_their_number_and_orders_stay_whole(spark, monkeypatch):
    from lobspark.operators import l3, ordered
    from lobspark.plans.queries_l3 import events
    from lobspark.plans.tables import Tables

    monkeypatch.setattr(ordered, "TASK_ROWS", 200)
    life = l3.order_lifecycle(events(Tables(spark, "/root/testdata/sf0.001")))
    assert life.rdd.getNumPartitions() >= life.count() // 200
    assert life.withColumn("p", F.spark_partition_id()).groupBy("order_id").agg(F.count_distinct("p").alias("n")).where("n > 1").isEmpty()
