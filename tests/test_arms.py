"""The matched arm study fits the whole ladder on every arm and judges one pool of candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lobspark.operators import arms as A
from lobspark.operators import cv
from lobspark.operators import evaluate as E
from lobspark.operators.boost import BoostParams, boosted_forecast, cut_points, fit_boosted, placed
from lobspark.operators.study import Gate
from lobspark.plans import queries_eval as Q
from lobspark.plans.tables import Tables

S = 10**9
BOOST = BoostParams(trees=3, depth=2, step=0.3, bins=8, min_rows=5)
ARMS = {"flow": ["x0"], "book": ["x2"], "combined": ["x0", "x2"]}


@pytest.fixture(scope="module")
def matrix(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(600):
        x0, y = float(rng.normal()), float(rng.normal() * 8)
        rows.append((i * S, i * S + S, i * S - S, "h1" if i % 3 else "h2", y, int(y > 5) - int(y < -5), x0, y / 2 + 2 * x0, 1.0, 0.2, 0.5 if i % 2 else 1.0, "tight" if i % 4 else "wide"))
    names = "t_event long, t_barrier long, t_feature_start long, horizon string, y_fwd_bps double, label int, x0 double, x2 double, cost_bps double, half_spread_bps double, uniqueness double, regime string"
    return spark.createDataFrame(rows, names).repartition(3).cache()


def study(matrix, **kw):
    gate = Gate(dsr_min=0.0, pbo_max=1.1, min_trades=10, min_effective=5, min_sharpe=-1, **kw)
    return A.run_arms_study(matrix, ARMS, control="flow", combined="combined", n_groups=6, k=2, embargo_ns=2 * S, max_lookback_ns=S, boost=BOOST, gate=gate, band=A.Band(200, 10, 0.1, 5), width=50 * S)


def test_candidates_of_all_arms_are_one_pool(matrix):
    c, regimes = study(matrix, extra_trials=4)
    found = {(r.horizon, r.arm, r.config): r for r in c.collect()}
    assert len(found) == 2 * 3 * 4 and {r.n_trials for r in found.values()} == {24 + 4}
    sharpes = [r.trade_sharpe for r in found.values() if r.horizon == "h1"]
    assert all(r.n_rows == (400 if r.horizon == "h1" else 200) for r in found.values()) and np.std(sharpes) > 0
    for h in ("h1", "h2"):
        best = max((found[h, "combined", g] for g in ("gbt_reg", "gbt_clf")), key=lambda r: r.net_pnl)
        twin = found[h, "flow", best.config]
        assert best.combined_id == best.id and abs(best.delta_net_pnl - (best.net_pnl - twin.net_pnl)) < 1e-6
        assert best.band_low < best.delta_net_pnl < best.band_high and best.beats_control == (best.band_low > 0)
        assert best.pbo is not None and found[h, "book", "naive"].net_pnl == 0
        can = [r for r in found.values() if r.horizon == h and r.arm != "flow" and r.config.startswith("gbt") and r.passes_solo]
        assert best.verdict == ("pass" if can and best.beats_control and best.pbo < 1.1 else "fail")
    can = [r for r in found.values() if r.verdict == "pass" and r.arm != "flow" and r.config.startswith("gbt") and r.passes_solo]
    assert can and [r for r in found.values() if r.is_winner] == [max(can, key=lambda r: r.net_pnl)]
    by = regimes.groupBy("horizon", "arm", "config").agg(F.sum("net_pnl").alias("net"), F.sum("n").alias("n")).collect()
    assert all(abs(r.net - found[r.horizon, r.arm, r.config].net_pnl) < 1e-6 and r.n == found[r.horizon, r.arm, r.config].n_rows for r in by)


def test_boosted_arms_equal_models_fitted_on_copied_rows(matrix):
    g = cv.split_groups(matrix, n_groups=6, k=2, embargo_ns=2 * S, keys=["horizon"], keep=["y_fwd_bps", "label", "uniqueness", "x0", "x2"], width=50 * S).cache()
    sets = A.feature_sets(ARMS, "flow", "combined", {})
    got = {(r.horizon, r.t_event): r.forecasts for r in A._boosted(g, sets, n_groups=6, k=2, keys=["horizon"], params=BOOST, label="label").collect()}
    for i, (_, _, cs) in enumerate(sets):
        x = placed(cv._exploded(g, 6, 2), cut_points(g, ["horizon"], cs, BOOST.bins), ["horizon"], cs)
        train = x.where("role = 'train'").select("horizon", "split", "bins", F.col("y_fwd_bps").alias("y"), "label", F.col("uniqueness").alias("w"))
        f = boosted_forecast(x.where("role = 'test'").select("horizon", "split", "t_event", "bins"), fit_boosted(train, ["horizon", "split"], BOOST), ["horizon", "split"])
        for r in f.groupBy("horizon", "t_event").agg(F.avg("f_reg").alias("a"), F.avg("f_clf").alias("b")).collect():
            assert np.allclose(got[r.horizon, r.t_event][2 * i : 2 * i + 2], [r.a, r.b], atol=1e-9)


def test_figures_equal_those_of_the_single_operators(matrix):
    x = matrix.withColumn("f", F.col("x2")).withColumns(E.net_pnl()).cache()
    got = {r.horizon: r for r in A.figures(x, ["horizon"]).collect()}
    plain = E.trade_summary(x, ["horizon"]).join(E.mcc(x, ["horizon"]), "horizon").join(E.weighted_sharpe(x, ["horizon"], traded_only=False).withColumnRenamed("sharpe", "sample_sharpe"), "horizon")
    plain = plain.join(E.weighted_sharpe(x, ["horizon"]).withColumnRenamed("sharpe", "trade_sharpe"), "horizon").join(E.sample_skew_kurt(x.filter("traded"), ["horizon"]).drop("n"), "horizon")
    for r in plain.collect():
        assert all(np.isclose(getattr(got[r.horizon], n), v) for n, v in r.asDict().items() if n != "horizon")


def test_equal_rows_are_not_multiplied(matrix):
    c, _ = study(matrix.unionAll(matrix.where("t_event % 7000000000 = 0")))
    n = matrix.where("horizon = 'h1'").count() + matrix.where("horizon = 'h1' and t_event % 7000000000 = 0").count()
    assert {r.n_rows for r in c.where("horizon = 'h1'").collect()} == {n}


def test_arms_must_be_matched():
    with pytest.raises(ValueError, match="shares features"):
        A.feature_sets({"a": ["x"], "b": ["x", "y"], "all": ["x", "y"]}, "a", "all", {})
    with pytest.raises(ValueError, match="all other arms"):
        A.feature_sets({"a": ["x"], "b": ["y"], "all": ["y"]}, "a", "all", {})


def test_the_query_has_every_rung_of_every_arm(spark):
    found = Q.matched_arm_study(Tables(spark, "/root/testdata/sf0.001"))
    assert {tuple(r) for r in found.select("arm", "config").distinct().collect()} == {(a, c) for a in Q.ARMS for c in A.CONFIGS}
