"""CSV scans: each file by its own header."""

import gzip

import pytest

from lobspark.sources.scans import scan_trades_csv


def test_files_with_other_column_orders_are_read_right_or_refused(spark, tmp_path):
    rows = [("2024-01-01T00:00:01.0000000", "2024-01-01T00:00:01.5000000", f"g{i}", str(100.0 + i), "2.0", "BUY") for i in range(4)]
    names = ["time_exchange", "time_received", "guid", "price", "base_amount", "taker_side"]
    for n, order in enumerate(([0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0])):
        with gzip.open(tmp_path / f"f{n}.csv.gz", "wt") as f:
            f.write("\n".join(";".join(x[i] for i in order) for x in (names, *rows[2 * n : 2 * n + 2])) + "\n")
    got = scan_trades_csv(spark, str(tmp_path), "2024-01-01", mixed=True).orderBy("trade_id").collect()
    assert [(r.trade_id, r.price, r.quantity, r.side) for r in got] == [(f"g{i}", 100.0 + i, 2.0, "buy") for i in range(4)]
    for f in {r.file for r in got}:
        seqs = [r.seq for r in sorted((r for r in got if r.file == f), key=lambda r: r.trade_id)]
        assert seqs == sorted(seqs)
    with pytest.raises(Exception):  # noqa: B017  (the engine's own error)
        scan_trades_csv(spark, str(tmp_path), "2024-01-01").collect()
    with gzip.open(tmp_path / "f2.csv.gz", "wt") as f:
        f.write("price\n1\n")
    with pytest.raises(ValueError):
        scan_trades_csv(spark, str(tmp_path), "2024-01-01", mixed=True)


def test_intermediates_are_deleted(spark, monkeypatch):
    import os

    from lobspark import session

    monkeypatch.setattr(session, "_written", [])
    stored = session.materialize(spark.range(3).toDF("x"))
    path = session._written[0]
    assert stored.count() == 3 and os.path.exists(path)
    assert session.clear_intermediates(spark) == 1 and not os.path.exists(path)


def test_headers_are_found_without_sorting_the_lines(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from lobspark.sources import scans

    def batch(rows):
        return pa.RecordBatch.from_pylist([dict(zip(("value", "file", "b"), r)) for r in rows])

    batches = [batch([("h1", "f1", 0), ("x", "f1", 0)]), batch([("y", "f1", 0), ("h2", "f2", 0), ("z", "f2", 0)]), batch([("m", "f2", 64), ("h3", "f3", 0)])]
    assert [r for b in scans._first_lines(iter(batches)) for r in b["value"].to_pylist()] == ["h1", "h2", "m", "h3"]
    seen = []
    whole = scans.F.min_by
    monkeypatch.setattr(scans.F, "min_by", lambda v, at: seen.append(at) or whole(v, at))
    rows = [("2024-01-01T00:00:01.0000000", "2024-01-01T00:00:01.5000000", f"g{i}", "1.0", "2.0", "BUY") for i in range(50_000)]
    names = ["time_exchange", "time_received", "guid", "price", "base_amount", "taker_side"]
    for n in range(2):  # plain files: several blocks each, whose first lines are no headers
        with open(tmp_path / f"f{n}.csv", "w") as f:
            f.write("\n".join(";".join(x[::-1] if n else x) for x in (names, *rows)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        got = scan_trades_csv(spark, str(tmp_path), "2024-01-01", mixed=True)
        assert got.count() == 100_000 and got.where("price = 1 and side = 'buy'").count() == 100_000 and seen == ["b"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
