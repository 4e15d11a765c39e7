"""Dollar bars of a day cut into chunks: same rows for every width."""

import numpy as np
import pandas as pd
import pytest

from lobspark.operators import bars as B
from lobspark.session import DAY_NS, HOUR_NS


@pytest.mark.parametrize("seed", range(12))
def test_next_closes_and_chunk_maps_match_the_fold(seed):
    g = np.random.default_rng(seed)
    n = int(g.integers(1, 500))
    ts = np.sort(g.integers(0, g.choice([300, 5000, 100_000]), n))
    x = g.integers(0, 9, n).astype(float) if seed % 2 else g.random(n) * 9  # whole numbers meet the threshold exactly
    thr, cap = float(g.integers(5, 40)), int(g.integers(20, 900))
    close, count = B.next_closes(ts, x, thr, cap)
    for i in range(n):
        bar, _, _, closed = B.assign_bars(B.OpenBar(0, int(ts[i])), ts[i + 1 :], x[i + 1 :], thr, cap)
        first = next((q for q, c in enumerate(closed) if c[2] == "threshold"), None)
        j, number = B._first_close(B.OpenBar(0, int(ts[i])), ts[i + 1 :], x[i + 1 :], thr, cap)
        assert (close[i] == n) == (first is None) and (first is None or (close[i], count[i]) == (i + 1 + j, first + 1) and number == first + 1)
    used = 0
    for at in range(0, n, 10):
        m = B.chunk_map(ts[at:], x[at:], thr, cap)
        used += m is not None
        walk = B._DayWalk(cap)
        walk.threshold = thr
        for since, held in ((int(ts[at]) - g.integers(0, cap), float(g.integers(0, int(thr)))), (int(ts[at]), 0.0)):
            walk.bar = B.OpenBar(7, int(since), held, 1)
            whole = B.assign_bars(walk.bar, ts[at:], x[at:], thr, cap)[0]
            assert walk._after({"last": None, "ts": ts[at:], "notional": x[at:], **(m or {})}) == whole
    test_next_closes_and_chunk_maps_match_the_fold.used = getattr(test_next_closes_and_chunk_maps_match_the_fold, "used", 0) + used


def test_some_chunks_were_shortened():
    assert test_next_closes_and_chunk_maps_match_the_fold.used > 20


def test_bars_are_equal_for_day_hour_and_minute_chunks(spark):
    g = np.random.default_rng(4)
    rows = []
    for symbol, n in (("hot", 4000), ("calm", 60)):
        ts = np.sort(g.integers(0, DAY_NS, n))
        rows.append(pd.DataFrame({"symbol": symbol, "dt": pd.Timestamp("1970-01-01").date(), "origin_ns": ts, "received_ns": ts + 5, "seq": np.arange(n), "side": g.choice(["buy", "sell"], n), "price": g.uniform(90, 110, n), "quantity": g.integers(1, 9, n).astype(float)}))
    trades = spark.createDataFrame(pd.concat(rows), "symbol string, dt date, origin_ns long, received_ns long, seq long, side string, price double, quantity double").cache()
    days = spark.sql("select symbol, date'1970-01-01' + d as dt, 4000D as threshold, d = 1 as is_warmup from values ('hot', 0), ('calm', 0), ('calm', 1) t(symbol, d)")
    tables = [B.dollar_bars(trades, days, 2 * HOUR_NS, width=w).toPandas().sort_values(["symbol", "dt", "bar_idx"]).reset_index(drop=True) for w in (DAY_NS, HOUR_NS, HOUR_NS // 60)]
    assert len(tables[0]) > 300 and set(tables[0].close_reason) == set(B.REASONS)
    for t in tables[1:]:
        pd.testing.assert_frame_equal(t, tables[0], rtol=1e-12)
