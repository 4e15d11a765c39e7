"""One pass over a trade day equals the single checks."""

import random

import pandas as pd

from lobspark.operators import trades as T

PARTS = (T.dup_timestamp_clusters, T.dup_trade_ids, T.price_checks, T.size_checks, T.notional_checks, T.interarrival, T.hour_coverage, T.lag_metrics, T.off_day_fraction, T.clock_flags)


def test_metrics_in_one_pass_equal_the_single_checks(spark):
    rng, day, day_ns = random.Random(4), "2024-03-01", 1_709_251_200 * 10**9
    nan, inf, rows = float("nan"), float("inf"), []
    for venue, n in (("a", 400), ("b", 60), ("c", 1)):
        for i in range(n):
            t = day_ns + rng.randrange(-3600, 90_000) * 10**9
            origin = rng.choice([t, t, t, None, 5]) if venue != "c" else None
            received = rng.choice([t + rng.randrange(-10**6, 10**7), None]) if venue != "c" else None
            price = rng.choice([100.0, 101.0, 99.5, 5000.0, 100.25]) if i % 60 else rng.choice([nan, None, inf])
            rows.append((venue, i, origin, received, rng.choice(["buy", "sell", "x", None]), price, rng.choice([1.0, 0.0, -1.0, 2.5, None, nan]), rng.choice([None, f"t{i}", f"t{i // 3}"])))
    df = spark.createDataFrame(rows, "venue string, pos long, origin_ns long, received_ns long, side string, price double, quantity double, trade_id string").selectExpr("*", f"date'{day}' as dt").cache()
    got = T.trade_day_metrics(df).toPandas().sort_values("venue").reset_index(drop=True)
    seen = set()
    for part in PARTS:
        want = part(df).toPandas()
        want = want.set_index("venue").reindex(got.venue).reset_index()
        for c in set(want.columns) - {"venue", "dt"}:
            seen.add(c)
            w = want[c].fillna(0) if c.startswith("dup_ts") else want[c]
            assert [str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else x for x in got[c]] == [str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else x for x in w] or pd.testing.assert_series_equal(got[c].astype(float), w.astype(float), check_names=False, rtol=1e-12) is None, c
    assert seen == set(got.columns) - {"venue", "dt"}
