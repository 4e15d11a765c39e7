"""The pipeline's near copies are found by SimHash deletion variants first."""

import random

from pyspark.sql import functions as F

from lobspark.llm import simhash


def test_fingerprints_within_three_bits_share_the_first_band(spark):
    fps = [0x1234_5678_9ABC_DEF0, 0x1234_5678_9ABC_DEF0 ^ 0b1011, 0x1234_5678_9ABC_DEF0 ^ (0b1111 << 30), 7, 0]
    rows = [(i, i, int(i < 4), fp, [100 + i] if i < 4 else []) for i, fp in enumerate(fps)]
    got = {r.cls: r.bands for r in simhash.with_simhash(spark.createDataFrame(rows, "cls long, text_hash long, n long, fp long, bands array<long>")).collect()}
    assert got[0][0] == got[1][0] and len({got[i][0] for i in (0, 2, 3)}) == 3
    assert [got[i][1:] for i in range(4)] == [[100], [101], [102], [103]] and got[4] == []


def test_near_copies_are_linked_without_bands_of_smallest_hashes(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    other = [f"v{rng.randrange(5000)}" for _ in range(3000)]
    texts = [base, [*base[:-1], "end"], other, [*other, "end"], other[::-1], [], None]
    df = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = simhash.with_simhash
    monkeypatch.setattr(simhash, "with_simhash", lambda c: whole(c).withColumn("bands", F.slice("bands", 1, 1)))
    group = dict(simhash.near_groups(df).selectExpr("row.doc_id", "group").collect())
    assert group[0] == group[1] and group[2] == group[3] and group[5] == group[6]
    assert len({group[i] for i in (0, 2, 4, 5)}) == 4
