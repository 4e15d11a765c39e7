"""Book folds against brute force on small random streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lobspark.operators import book as B
from lobspark.operators import reseed as R
from lobspark.operators.reads import observable_deltas


def stream(n=400, seed=1, span=4000):
    g = np.random.default_rng(seed)
    side = g.choice(["bid", "ask"], n)
    return pd.DataFrame(
        {
            "symbol": "A",
            "origin_ns": np.sort(g.integers(1, span, n)),
            "seq": np.arange(n),
            "side": side,
            "tick": np.where(side == "bid", g.integers(90, 104, n), g.integers(98, 112, n)),
            "size": g.choice([0.0, 1.0, 2.0, 3.0], n),
            "received_ns": 0,
        }
    ).assign(received_ns=lambda d: d.origin_ns + g.integers(0, 300, n))


def state(rows):
    book = {"bid": {}, "ask": {}}
    for r in rows:
        if r.size == 0:
            book[r.side].pop(r.tick, None)
        else:
            book[r.side][r.tick] = r.size
    return book


def top(book, k):
    b = sorted(book["bid"], reverse=True)[:k]
    a = sorted(book["ask"])[:k]
    pad = lambda x, s: [(x[i] / 100, book[s][x[i]]) if i < len(x) else (None, None) for i in range(k)]
    return pad(b, "bid") + pad(a, "ask")


@pytest.mark.parametrize("width", [100, 700, 10_000])
def test_book_asof_equals_brute_force(spark, width):
    d = stream()
    probes = pd.DataFrame({"symbol": "A", "sample_ts": np.arange(0, 4200, 37)})
    out = B.book_asof(spark.createDataFrame(d), spark.createDataFrame(probes), k=3, width=width).collect()
    assert len(out) == len(probes)
    ev = list(d.sort_values(["origin_ns", "seq"]).itertuples())
    for r in out:
        want = top(state([e for e in ev if e.origin_ns <= r.sample_ts]), 3)
        got = [(r[f"{s}_{i}_price"], r[f"{s}_{i}_size"]) for s in ("bid", "ask") for i in range(3)]
        assert got == want


def test_later_rows_cannot_change_earlier_samples(spark):
    d = stream()
    probes = spark.createDataFrame(pd.DataFrame({"symbol": "A", "sample_ts": np.arange(0, 2000, 50)}))
    full = B.book_asof(spark.createDataFrame(d), probes, k=2, width=500).toPandas()
    cut = B.book_asof(spark.createDataFrame(d[d.origin_ns <= 2000].sample(frac=1, random_state=3)), probes, k=2, width=500).toPandas()
    by = lambda x: x.sort_values("sample_ts").reset_index(drop=True)
    pd.testing.assert_frame_equal(by(full), by(cut))


def test_observable_book_with_stragglers(spark):
    d = stream(300, seed=5)
    probes = pd.DataFrame({"symbol": "A", "sample_ts": np.arange(0, 4200, 61)})
    obs = observable_deltas(spark.createDataFrame(d), width=500)
    out = B.book_asof(obs, spark.createDataFrame(probes), k=2, ts="received_ns", width=500).collect()
    ev = list(d.sort_values(["origin_ns", "seq"]).itertuples())
    for r in out:
        want = top(state([e for e in ev if e.received_ns <= r.sample_ts]), 2)
        assert [(r[f"{s}_{i}_price"], r[f"{s}_{i}_size"]) for s in ("bid", "ask") for i in range(2)] == want


def test_quote_path_equals_brute_force(spark):
    d = stream(250, seed=9)
    out = {(r.ts, r.seq): r for r in B.quote_path(spark.createDataFrame(d), width=900).collect()}
    ev = list(d.sort_values(["origin_ns", "seq"]).itertuples())
    for i, e in enumerate(ev):
        b = state(ev[: i + 1])
        r = out[(e.origin_ns, e.seq)]
        assert r.best_bid == (max(b["bid"]) / 100 if b["bid"] else None)
        assert r.best_ask == (min(b["ask"]) / 100 if b["ask"] else None)


def brute_replay(d, snaps, grid, after):
    ev = [(e.origin_ns, 1, e) for e in d.itertuples()] + [(s[0], 2, s) for s in snaps] + [(g, 3, None) for g in grid]
    ev.sort(key=lambda x: (x[0], x[1], x[2].seq if x[1] == 1 else 0))
    book, seeded, since, dur, reseeds, blocked, out = {"bid": {}, "ask": {}}, False, None, 0, [], 0, []
    for t, kind, e in ev:
        if kind == 1:
            (book[e.side].pop(e.tick, None) if e.size == 0 else book[e.side].__setitem__(e.tick, e.size))
        elif kind == 2:
            _, ok, bids, asks = e
            if not seeded:
                if ok:
                    book, seeded, seed = {"bid": dict(bids), "ask": dict(asks)}, True, t
            elif since is not None and t - since >= after:
                if ok:
                    book = {"bid": dict(bids), "ask": dict(asks)}
                    reseeds.append(t)
                else:
                    blocked += 1
        else:
            out.append((t, top(book, 2)))
            continue
        if seeded:
            crossed = bool(book["bid"]) and bool(book["ask"]) and max(book["bid"]) >= min(book["ask"])
            if crossed and since is None:
                since = t
            elif not crossed and since is not None:
                dur += t - since
                since = None
    last = max(x[0] for x in ev)
    if since is not None and last > since:
        dur += last - since
    return out, seed, reseeds, blocked, dur


def test_seeded_replay_equals_brute_force(spark):
    d = stream(500, seed=4).assign(dt=pd.Timestamp("2024-01-01").date())
    grid = list(range(0, 4200, 40))
    snaps = []
    for i, t in enumerate(range(150, 4000, 170)):
        shift = 5 if i % 4 == 2 else 0
        snaps.append((t, shift == 0, {99 + shift: 5.0, 98 + shift: 5.0}, {101: 5.0, 102: 5.0}))
    sp = pd.DataFrame(
        {
            "symbol": "A", "dt": pd.Timestamp("2024-01-01").date(), "sample_ts": [s[0] for s in snaps],
            "bids": [[(t / 100, z) for t, z in sorted(s[2].items(), reverse=True)] for s in snaps],
            "asks": [[(t / 100, z) for t, z in sorted(s[3].items())] for s in snaps],
        }
    )
    lad = "array<struct<px:double,sz:double>>"
    s = spark.createDataFrame(sp, f"symbol string, dt date, sample_ts bigint, bids {lad}, asks {lad}")
    g = spark.createDataFrame(pd.DataFrame({"symbol": "A", "dt": pd.Timestamp("2024-01-01").date(), "sample_ts": grid}))
    for batch, width in (("10000", None), ("37", None), ("37", 500)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        tagged = R.book_replay_seeded(spark.createDataFrame(d), s, g, k=2, policy=R.ReseedPolicy(reseed_after_ns=120), width=width).collect()
        want, seed, reseeds, blocked, dur = brute_replay(d, snaps, grid, 120)
        got = {r.ts: [(r[f"{x}_{i}_price"], r[f"{x}_{i}_size"]) for x in ("bid", "ask") for i in range(2)] for r in tagged if r.row_type == "sample"}
        assert [got[t] for t, _ in want] == [w for _, w in want]
        m = [r for r in tagged if r.row_type == "metrics"][0]
        assert sorted(r.ts for r in tagged if r.row_type == "reseed") == reseeds and len(reseeds) > 0
        assert (m.seed_ts, m.reseed_count, m.reseed_blocked, m.crossed_duration_ns) == (seed, len(reseeds), blocked, dur)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


@pytest.mark.parametrize("after,ok_every,spread", [(60, 1, 0), (300, 3, 4), (120, 10**6, 0)])
def test_seeded_replay_in_buckets_equals_one_fold(spark, after, ok_every, spread):
    lad = "array<struct<px:double,sz:double>>"
    day = pd.Timestamp("1970-01-01").date()
    d = pd.concat([stream(400, seed=s).assign(symbol=x, dt=day) for x, s in (("A", 21), ("B", 22))])
    snaps = [(x, day, t, [(0.99 - 0.01 * q, 5.0) for q in range(2)], [((1.01 if i % ok_every == 0 else 0.5) + 0.01 * (q + spread), 5.0) for q in range(2)]) for x in "AB" for i, t in enumerate(range(90, 4000, 130))]
    s = spark.createDataFrame(snaps, f"symbol string, dt date, sample_ts bigint, bids {lad}, asks {lad}")
    g = spark.createDataFrame([(x, day, t) for x in "AB" for t in range(0, 4200, 70)], "symbol string, dt date, sample_ts bigint")
    tables = [R.book_replay_seeded(spark.createDataFrame(d), s, g, k=2, policy=R.ReseedPolicy(reseed_after_ns=after), width=w).toPandas().sort_values(["symbol", "row_type", "ts"]).reset_index(drop=True) for w in (None, 600)]
    assert len(tables[0]) > 120
    for t in tables[1:]:
        pd.testing.assert_frame_equal(t, tables[0])


def test_hand_book_at_trade(spark):
    rows = [(10, 0, "bid", 10000, 2.0), (10, 1, "ask", 10100, 3.0), (30, 2, "bid", 10000, 0.0), (30, 3, "bid", 9900, 1.0), (50, 4, "ask", 10100, 0.0), (50, 5, "ask", 10200, 4.0)]
    d = spark.createDataFrame([("A", *r) for r in rows], "symbol string, origin_ns bigint, seq bigint, side string, tick bigint, size double")
    t = spark.createDataFrame([("A", 20), ("A", 40), ("A", 60)], "symbol string, sample_ts bigint")
    out = {r.sample_ts: (r.bid_0_price, r.ask_0_price, r.mid) for r in B.book_asof(d, t, k=1, width=25).collect()}
    assert out == {20: (100.0, 101.0, 100.5), 40: (99.0, 101.0, 100.0), 60: (99.0, 102.0, 100.5)}


def test_grid_step_must_divide_day(spark):
    with pytest.raises(ValueError):
        B.grid(spark.range(1).select(F.lit("A").alias("symbol"), F.current_date().alias("dt")), 7)
