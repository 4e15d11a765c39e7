"""The checked sink publishes sound tables only; stage checks count breaches while tables are stored."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from lobspark.operators import contracts as K
from lobspark.sources.publish import ContractBreach, StageChecks, publish

def rules_x():
    return {"negative": F.col("x") < 0}



def rows(spark, data):
    return spark.createDataFrame(data, "h string, t long, x double, more string")


@pytest.fixture
def out(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def test_published_in_column_order_sorted_by_key(spark, out):
    d = rows(spark, [("b" if i % 3 else "a", 1000 - i, float(i), "m") for i in range(300)])
    assert publish(d, out, keys=["t"], rules=rules_x(), columns=["x", "t", "h"], partitions=["h"]) == 300
    back = spark.read.parquet(out)
    assert back.columns == ["x", "t", "h"] and back.count() == 300
    for r in back.select("t", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").groupBy("f").agg(F.collect_list("t").alias("ts")).collect():
        assert r.ts == sorted(r.ts)


@pytest.mark.parametrize(
    ("bad", "want"),
    [(("a", 5, -1.0, "m"), [("publish", "negative", 1)]), (("a", 5, None, "m"), [("publish", "negative", 1)]), (("a", 3, 1.0, "m"), [("publish", "repeated_key", 1)])],
)
def test_breach_leaves_nothing(spark, out, bad, want):
    d = rows(spark, [("a", i, 1.0, "m") for i in range(4)] + [bad])
    with pytest.raises(ContractBreach) as e:
        publish(d, out, keys=["t"], rules=rules_x(), partitions=["h"])
    assert e.value.counts == want
    assert os.listdir(os.path.dirname(out)) == []


def test_null_keys_are_equal(spark, out):
    with pytest.raises(ContractBreach) as e:
        publish(rows(spark, [("a", None, 1.0, "m")] * 3), out, keys=["t"], rules=rules_x())
    assert e.value.counts == [("publish", "repeated_key", 2)]


def test_existing_target_is_refused_and_kept(spark, out):
    publish(rows(spark, [("a", 1, 1.0, "m")]), out, keys=["t"], rules=rules_x())
    with pytest.raises(FileExistsError):
        publish(rows(spark, [("a", 2, 1.0, "m")]), out, keys=["t"], rules=rules_x())
    assert [r.t for r in spark.read.parquet(out).collect()] == [1]


def test_schema_faults_fail_first(spark, out):
    d = rows(spark, [("a", 1, 1.0, "m")])
    for columns in (["h", "x"], ["h", "t", "t"], ["h", "t", "y"]):
        with pytest.raises(ValueError, match="columns missing"):
            publish(d, out, keys=["t"], rules=rules_x(), columns=columns, partitions=["h"])


def test_empty_table(spark, out):
    assert publish(rows(spark, []), out, keys=["t"], rules=rules_x()) == 0
    assert spark.read.schema("t long").parquet(out).count() == 0


BAR = {"threshold": 1.0, "cap_fire": None, "last_origin": 9, "interval_start": 5, "max_received": 10, "t_event": 10, "close_reason": "threshold", "notional": 1.0}
READ = {"reason": None, "t_event": 10, "target_read_ts": 9, "mid": 1.5, "microprice": 1.5} | {f"{s}_{i}_{f}": v for s, i, f, v in [("bid", 0, "price", 1.0), ("bid", 1, "price", 0.5), ("ask", 0, "price", 2.0), ("ask", 1, "price", 3.0), ("bid", 0, "size", 1.0), ("ask", 0, "size", 1.0)]}
COST = {"half_spread_bps": 1.0, "latency_drift_bps": 0.0, "slippage_bps": 1.0, "cost_bps": 2.0}
SPAN = {"t_event": 10, "t_barrier": 11, "t_feature_start": 9}
PATH = {"symbol": "s", "ts": 10, "mid": 1.0}
BREACHES = [
    ("bars", BAR, K.bar_rules, {"threshold": -1.0}, "bad_threshold"),
    ("bars", BAR, K.bar_rules, {"interval_start": 10}, "close_before_start"),
    ("bars", BAR, K.bar_rules, {"max_received": 11}, "received_after_event"),
    ("bars", BAR, K.bar_rules, {"close_reason": "other"}, "unknown_reason"),
    ("bars", BAR, K.bar_rules, {"notional": 0.5}, "threshold_not_reached"),
    ("bars", BAR, K.bar_rules, {"close_reason": "time_cap"}, "cap_without_fire"),
    ("reads", READ, lambda: K.read_rules(2), {"microprice": float("nan")}, "bad_touch"),
    ("reads", READ, lambda: K.read_rules(2), {"bid_0_price": 2.0, "mid": 2.0}, "crossed_or_locked"),
    ("reads", READ, lambda: K.read_rules(2), {"ask_1_price": 2.0}, "ladder_not_monotone"),
    ("reads", READ, lambda: K.read_rules(2), {"target_read_ts": 11}, "read_after_event"),
    ("reads", READ, lambda: K.read_rules(2), {"mid": 1.6}, "mid_mismatch"),
    ("costs", COST, K.cost_rules, {"cost_bps": -1.0}, "bad_cost_bps"),
    ("spans", SPAN, K.span_rules, {"t_barrier": 10}, "empty_span"),
    ("spans", SPAN, K.span_rules, {"t_feature_start": 11}, "negative_lookback"),
    ("spans", SPAN, K.span_rules, {"t_event": None}, "null_time"),
    ("path", PATH, K.path_rules, {"mid": 0.0, "ts": 11}, "bad_mid"),
    ("path", PATH, K.path_rules, {"ts": 10}, "not_increasing"),
]


def test_every_stage_breach_stops_the_publish(spark, out):
    for stage, sound, rules, change, rule in BREACHES:
        kinds = {str: "string", int: "long", float: "double", type(None): "long" if "cap" in stage or stage == "bars" else "string"}
        schema = ", ".join(f"{c} {kinds[type(v)]}" for c, v in sound.items())
        d = spark.createDataFrame([tuple(sound.values()), tuple((sound | change).values())], schema)
        checks = StageChecks()
        kept = checks.store(stage, K.with_previous(d, ["symbol"]) if stage == "path" else d, rules())
        assert sorted(kept.columns) == sorted(sound)
        assert checks.broken() == [(stage, rule, 1)], (stage, rule)
        with pytest.raises(ContractBreach) as e:
            publish(rows(spark, [("a", 1, 1.0, "m")]), out, keys=["t"], rules=rules_x(), checks=checks)
        assert e.value.counts == [(stage, rule, 1)] and not os.path.exists(out)


def test_sound_stages_count_nothing(spark):
    checks = StageChecks()
    checks.store("spans", spark.createDataFrame([tuple(SPAN.values())] * 3, "t_event long, t_barrier long, t_feature_start long"), K.span_rules())
    checks.store("empty", spark.createDataFrame([], "t_event long, t_barrier long, t_feature_start long"), K.span_rules())
    assert not checks.broken() and {r.n for r in checks.table(spark).collect()} == {0}
