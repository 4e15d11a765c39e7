"""Hand fixtures for the late rule, the drain marker and the update-id chain."""

import pandas as pd

from lobspark.operators import updates as U
from lobspark.streaming.stateful import FLUSH, _Buffered, admit


def rows(ts, kind=0):
    return pd.DataFrame({"ts": ts, "kind": kind, "seq": range(len(ts)), "arrival": range(len(ts))})


def test_late_rule_follows_arrival_order():
    kept, seen, late = admit(rows([10, 30, 21, 20, 40, 30]), None, 10)
    assert kept.ts.tolist() == [10, 30, 21, 40] and seen == 40 and late == 2  # 20 <= 30-10, 30 <= 40-10


class Memory:
    """A state variable kept in memory."""

    def __init__(self, *_):
        self.v = None

    exists = lambda self: self.v is not None
    get = lambda self: self.v
    clear = lambda self: setattr(self, "v", None)
    update = put = lambda self, v: setattr(self, "v", v)


class Plain(_Buffered):
    EVENT = [(n, "bigint", int) for n in ("ts", "kind", "seq", "late")]
    getValueState = getListState = staticmethod(Memory)

    def release(self, key, out, end):
        yield out

    def take(self, pdf):
        return list(self.handleInputRows(("A",), iter([pdf]), None))[0]


def test_buffer_releases_in_order_across_batches_and_drains():
    b = Plain(10)
    b.init(b)
    first = b.take(rows([10, 25, 18]))
    assert first.ts.tolist() == [10] and b.buffer.v == [(25, 0, 1, 0), (18, 0, 2, 0)]
    assert b.take(rows([40])).ts.tolist() == [18, 25]
    out = b.take(rows([0], kind=FLUSH))
    assert out.ts.tolist() == [40] and out.late.tolist() == [0] and not b.clock.exists() and not b.buffer.exists()


def test_futures_chain_verdicts(spark):
    cols = "symbol string, event_type string, event_time bigint, first_id bigint, final_id bigint, prev_id bigint, last_id bigint, side string, tick bigint, size double"
    ev = [
        ("A", "update", 1, 1, 5, 0, None, "bid", 100, 1.0),
        ("A", "snapshot", 2, None, None, None, 10, "bid", 100, 1.0),
        ("A", "update", 3, 9, 12, 8, None, "bid", 100, 2.0),
        ("A", "update", 4, 13, 15, 12, None, "bid", 101, 2.0),
        ("A", "update", 5, 18, 20, 17, None, "bid", 102, 2.0),
    ]
    g = U.group_update_events(spark.createDataFrame(ev, cols))
    out = {r.order_id: r.verdict for r in U.check_id_continuity(g, "futures").collect()}
    assert out == {5: "pre_snapshot", 10: "snapshot", 12: "anchor", 15: "applied", 20: "sequence_gap"}


def test_broken_chain_empties_the_book_until_the_next_snapshot(spark):
    cols = "symbol string, event_type string, event_time bigint, first_id bigint, final_id bigint, prev_id bigint, last_id bigint, side string, tick bigint, size double"
    ev = [
        ("A", "snapshot", 2, None, None, None, 10, "bid", 100, 1.0),
        ("A", "update", 3, 9, 12, 8, None, "ask", 101, 2.0),
        ("A", "update", 4, 15, 17, 14, None, "bid", 99, 2.0),
        ("A", "update", 5, 18, 20, 17, None, "bid", 98, 2.0),
        ("A", "snapshot", 6, None, None, None, 30, "bid", 97, 1.0),
    ]
    r = spark.createDataFrame(ev, cols)
    checked = U.check_id_continuity(U.group_update_events(r), "futures")
    assert {x.order_id: (x.epoch, x.chain_ok) for x in checked.collect()} == {10: (10, True), 12: (10, True), 17: (10, False), 20: (10, False), 30: (30, True)}
    d = {(x.origin_ns, x.side, x.tick): x.size for x in U.replay_deltas(r, checked).collect()}
    # the break removes both levels; so does, again, the snapshot after it
    assert d == {(2, "bid", 100): 1.0, (3, "ask", 101): 2.0, (4, "bid", 100): 0.0, (4, "ask", 101): 0.0, (6, "bid", 100): 0.0, (6, "ask", 101): 0.0, (6, "bid", 97): 1.0}


def test_regressing_event_times_and_the_halt(spark):
    cols = "symbol string, event_type string, event_time bigint, first_id bigint, final_id bigint, prev_id bigint, last_id bigint, side string, tick bigint, size double"
    ev = [
        ("A", "update", 90, 1, 5, 0, None, "bid", 100, 1.0),
        ("A", "snapshot", 100, None, None, None, 10, "bid", 100, 1.0),
        ("A", "update", 101, 9, 12, 8, None, "bid", 100, 2.0),
        ("A", "update", 99, 13, 15, 12, None, "bid", 101, 2.0),
        ("A", "snapshot", 98, None, None, None, 30, "bid", 97, 1.0),
        ("A", "snapshot", 120, None, None, None, 40, "bid", 97, 1.0),
        ("A", "update", 121, 39, 44, 38, None, "bid", 98, 2.0),
        ("B", "update", 5, 1, 2, 0, None, "bid", 98, 2.0),
    ]
    checked = U.check_id_continuity(U.group_update_events(spark.createDataFrame(ev, cols)), "futures")
    got = {(x.symbol, x.order_id): (x.verdict, x.chain_ok, x.regresses) for x in checked.collect()}
    assert got == {
        ("A", 5): ("pre_snapshot", True, False), ("A", 10): ("snapshot", True, False), ("A", 12): ("anchor", True, False), ("A", 15): ("ordering_anomaly", False, True),
        ("A", 30): ("backwards_snapshot", False, True), ("A", 40): ("snapshot", True, False), ("A", 44): ("anchor", True, False), ("B", 2): ("pre_snapshot", True, False),
    }
    s = {r.symbol: r for r in U.chain_summary(checked).collect()}
    assert (s["A"].events, s["A"].snapshots_applied, s["A"].updates_applied, s["A"].resets, s["A"].halt, s["A"].halt_id) == (4, 1, 1, 0, "ordering_anomaly", 15)
    assert (s["B"].halt, s["B"].halt_id, s["B"].updates_skipped_pre_snapshot) == ("missing_initial_snapshot", None, 1)
