"""Histogram boosting: one tree against plain loops, signal and noise through the study's gate."""

import numpy as np
import pandas as pd
import pytest

from lobspark.operators import boost as G


def frame(n, seed, strength):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 3)).round(3)
    y = strength * np.where(x[:, 0] > 0, 1.0, -1.0) * (1 + (x[:, 1] > 0.5)) + g.normal(size=n) * 4
    return pd.DataFrame({"h": np.where(np.arange(n) % 3 == 0, "a", "b"), "split": 0, "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "y": y, "label": np.sign(np.round(y / 6)).astype(int), "w": g.uniform(0.2, 1, n)})


def grow(d, params):
    """One regression tree on binned rows, by plain loops: {node: (feature, cut)}, value of each node."""
    mean = np.average(d.y, weights=d.w)
    x, gr, h = np.stack(d.bins), (d.w * (mean - d.y)).to_numpy(), d.w.to_numpy()
    cuts, todo, value = {}, [(0, np.arange(len(d)))], {}
    while todo:
        node, rows = todo.pop(0)
        value[node] = -gr[rows].sum() / h[rows].sum()
        if node >= 2**params.depth - 1:
            continue
        best = None
        for f in range(x.shape[1]):
            for c in range(params.bins):
                left = x[rows, f] <= c
                if min(left.sum(), (~left).sum()) < params.min_rows:
                    continue
                parts = [gr[rows[q]].sum() ** 2 / h[rows[q]].sum() for q in (left, ~left)]
                gain = round(sum(parts) - gr[rows].sum() ** 2 / h[rows].sum(), 6)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, f, c, rows[left], rows[~left]
        if best:
            cuts[node] = best[1:3]
            todo += [(2 * node + 1, best[3]), (2 * node + 2, best[4])]
    return cuts, value


def test_first_tree_equals_plain_loops(spark):
    params = G.BoostParams(trees=1, depth=3, step=0.5, bins=8, min_rows=20)
    d = G.binned(spark.createDataFrame(frame(900, 3, 2.0)), ["h"], ["x0", "x1", "x2"], params.bins).cache()
    fit = G.fit_boosted(d.select("h", "split", "bins", "y", "label", "w"), ["h", "split"], params)
    for i, (h, _) in enumerate(fit.names):
        cuts, value = grow(d.where(d.h == h).toPandas(), params)
        t = fit.trees[0]
        got = {n: (int(t.feature[i, 0, n]), int(t.cut[i, 0, n])) for n in range(7) if t.feature[i, 0, n] >= 0}
        assert got == cuts and len(cuts) > 2
        for n, v in value.items():
            assert t.value[i, 0, n] == pytest.approx(v, rel=1e-9)
    f = G.boosted_forecast(d, fit, ["h", "split"]).toPandas()
    assert np.corrcoef(f.f_reg, f.y)[0, 1] > 0.3 and np.corrcoef(f.f_clf, f.y)[0, 1] > 0.3


def test_degenerate_models_forecast_nothing(spark):
    d = pd.DataFrame({"h": ["one", "flat", "flat", "flat"], "split": 0, "bins": [[0]] * 4, "y": [1.0, 2.0, 3.0, 4.0], "label": [1, 0, 0, 0], "w": 1.0})
    rows = spark.createDataFrame(d, "h string, split int, bins array<int>, y double, label int, w double")
    fit = G.fit_boosted(rows, ["h", "split"], G.BoostParams(trees=2, depth=2))
    got = G.boosted_forecast(rows.unionByName(rows.limit(1).withColumn("h", rows.h.substr(1, 1))), fit, ["h", "split"]).toPandas().groupby("h")[["f_reg", "f_clf"]].max()
    assert got.loc["one"].tolist() == got.loc["o"].tolist() == [0, 0] and got.loc["flat"].tolist() == [pytest.approx(3.0), 0]
    assert G.boosted_forecast(rows.where("false"), G.fit_boosted(rows.where("false"), ["h", "split"], G.BoostParams()), ["h", "split"]).count() == 0


@pytest.mark.parametrize("strength,passes", [(8.0, True), (0.0, False)])
def test_gate_passes_on_a_planted_signal_and_fails_on_noise(spark, strength, passes):
    from lobspark.operators.study import Gate, check_lookback, run_study

    n, g = 3000, np.random.default_rng(7)
    d = frame(n, 5, strength)
    d = d.assign(horizon="10s", t_event=np.arange(n) * 10, t_barrier=np.arange(n) * 10 + 30, t_feature_start=np.arange(n) * 10 - 20, y_fwd_bps=d.y, uniqueness=0.5, cost_bps=1.0, half_spread_bps=0.2, regime=np.where(g.random(n) < 0.5, "tight", "wide"), micro=0.0)
    rows = spark.createDataFrame(d.drop(columns=["h", "split", "y", "w"]))
    keep = ["y_fwd_bps", "cost_bps", "half_spread_bps", "uniqueness", "regime"]
    boost = G.BoostParams(trees=6, depth=2, step=0.4, bins=16)
    c, regimes = run_study(rows, features=["x0", "x1", "x2"], micro="micro", n_groups=4, k=1, embargo_ns=20, max_lookback_ns=20, keep=keep, boost=boost, gate=Gate(), width=1000)
    c = c.toPandas().set_index("model")
    assert set(c.index) == {"naive", "microprice", "ridge", *G.RUNGS}
    assert (c.verdict == "pass").any() == passes and not c.loc[["naive", "ridge", "microprice"], "is_winner"].any()
    if passes:
        assert set(regimes.toPandas().regime) == {"tight", "wide"} and (regimes.toPandas().net_pnl > 0).all()
    else:
        assert regimes.count() == 0
    for wrong in ({"embargo_ns": 10, "max_lookback_ns": 20}, {"embargo_ns": 30, "max_lookback_ns": 10}):
        with pytest.raises(ValueError):
            check_lookback(rows, **wrong)


def test_rows_with_equal_bins_and_label_are_boosted_as_one(spark):
    params = G.BoostParams(trees=12, depth=2, step=0.3, bins=4, min_rows=20)
    d = G.binned(spark.createDataFrame(frame(1500, 11, 2.0)), ["h"], ["x0", "x1"], params.bins).cache()
    _, rows = G.started(d.select("h", "split", "bins", "y", "label", "w"), ["h", "split"], params)
    assert rows.count() <= 2 * 4 * 4 * 3 and rows.agg({"n": "sum"}).first()[0] == 1500
    fit = G.fit_boosted(d.select("h", "split", "bins", "y", "label", "w"), ["h", "split"], params)
    one = d.where("h = 'a'").toPandas()
    x, score = np.stack(one.bins), np.full(len(one), np.average(one.y, weights=one.w))
    for t in fit.trees:  # leaves of every tree against the single rows, also after scores were stored
        node, _ = t.nodes(np.zeros(len(one), int), x, 0, params.depth)
        for leaf in np.unique(node):
            i = node == leaf
            assert t.value[0, 0, leaf] == pytest.approx(np.average(one.y[i] - score[i], weights=one.w[i]), rel=1e-7, abs=1e-9)
        score += params.step * t.value[0, 0, node]


def test_models_grown_in_a_task_equal_those_grown_level_by_level(spark, monkeypatch):
    params = G.BoostParams(trees=3, depth=3, step=0.4, bins=8, min_rows=20)
    d = G.binned(spark.createDataFrame(frame(900, 5, 2.0)), ["h"], ["x0", "x1", "x2"], params.bins).cache()
    rows = d.select("h", "split", "bins", "y", "label", "w")
    one = G.fit_boosted(rows, ["h", "split"], params)
    monkeypatch.setattr(G, "IN_TASK", 0)
    two = G.fit_boosted(rows, ["h", "split"], params)
    for a, b in zip(one.trees, two.trees):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.feature >= 0).sum() > 8
        assert np.allclose(a.value, b.value, rtol=1e-9, atol=1e-12)


def test_gbt_fits_take_few_jobs_and_know_three_classes(spark):
    from lobspark.operators import cv

    d = frame(3000, 7, 6.0)
    rows = spark.createDataFrame(d).withColumnRenamed("w", "uniqueness").cache()
    rows.count()
    sc = spark.sparkContext
    sc.setJobGroup("gbt", "gbt")
    clf = cv.fit_gbt_clf(rows, ["x0", "x1"], trees=30, depth=3)
    reg = cv.fit_gbt_reg(rows, ["x0", "x1"], y="y", trees=30, depth=3)
    jobs = len(sc.statusTracker().getJobIdsForGroup("gbt"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60
    f = cv.gbt_clf_forecast(clf, rows, ["x0", "x1"], 10.0).toPandas()
    assert abs(f.f).max() <= 10 and np.corrcoef(f.f, f.y)[0, 1] > 0.5
    f = cv.gbt_forecast(reg, rows, ["x0", "x1"]).toPandas()
    assert np.corrcoef(f.f, f.y)[0, 1] > 0.5
