"""Joins of training rows with a row per model send the models to the tasks, however small Spark takes the rows to be."""

import re

from lobspark.operators import boost as G


def sent(df):
    """Side that every broadcast join of the plan sends, and the plan."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    joins = re.findall(r"BroadcastHashJoin .*?, (BuildLeft|BuildRight)", plan)
    return joins, plan


def test_models_are_sent_to_the_training_rows(spark, tmp_path, monkeypatch):
    rows = [("a" if i % 3 else "b", i % 2, [i % 4, i % 5], float(i % 7), i % 3 - 1, 1.0) for i in range(60)]
    spark.createDataFrame(rows, "h string, split int, bins array<int>, y double, label int, w double").write.parquet(f"{tmp_path}/t")
    train = spark.read.parquet(f"{tmp_path}/t")  # a few kilobytes: below every threshold
    seen = []
    monkeypatch.setattr(G, "materialize", lambda df: seen.append(df) or df)
    fit, numbered = G.started(train, ["h", "split"], G.BoostParams(trees=1, depth=2, bins=5, min_rows=2))
    assert numbered.count() == 60 and len(fit.names) == 4
    joins, plan = sent(seen[0])
    assert joins == ["BuildRight"], plan
    forecast = G.boosted_forecast(train, fit, ["h", "split"])
    assert sent(forecast)[0] == ["BuildRight"] and forecast.count() == 60
