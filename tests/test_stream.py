"""Streams give what batches give, however they are cut."""

import pytest

from larkspur.operators import features as ft
from larkspur.operators.store import Table
from larkspur.sources import events as src
from larkspur.streaming.processor import process_available
from larkspur.system import Config, FeatureSystem, promoted


def made(spark, n):
    return src.made_stream_events(spark, n)


def test_log_offsets_and_ranges(spark, tmp_path):
    log = src.EventLog(spark, str(tmp_path / "log"))
    assert log.append(made(spark, 5)) == 0 and log.append(made(spark, 3)) == 5 and log.next_offset() == 8
    assert [r.offset for r in log.read_from(6).collect()] == [6, 7] and [r.offset for r in log.read_from(1, 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        log.read_from(-1)
    offsets = src.Offsets(str(tmp_path / "offsets.json"))
    offsets.commit("g", 4)
    assert offsets.get("g") == 4 and offsets.get("other") == 0


def test_stream_equals_batch_in_any_cut(spark, tmp_path):
    log, store = src.EventLog(spark, str(tmp_path / "log")), Table(spark, str(tmp_path / "store"))
    for lo, hi in ((0, 40), (40, 45), (45, 120)):
        log.append(made(spark, 120).where(f"pos >= {lo} and pos < {hi}"))
        process_available(log, store, str(tmp_path / "cp"), max_files=2)
    process_available(log, store, str(tmp_path / "cp"))  # nothing new
    got = {r.key: r.value for r in store.snapshot().collect() if not r.key.startswith("stream:")}
    assert got == {r.key: r.value for r in ft.as_cells(ft.window_features(made(spark, 120))).collect()}


def test_groups_are_independent_and_bad_events_quarantined(spark, tmp_path):
    log = src.EventLog(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([("1", "click", None, 5, None, 0), (None, "click", None, 6, None, 1)], src.EVENT))
    a = Table(spark, str(tmp_path / "a"))
    process_available(log, a, str(tmp_path / "cpa"), quarantine=str(tmp_path / "bad"))
    assert a.get("feature:user:1:window:0:click_count") == "1" and spark.read.json(str(tmp_path / "bad")).count() == 1
    with pytest.raises(Exception, match="missing user_id"):
        process_available(log, Table(spark, str(tmp_path / "b")), str(tmp_path / "cpb"))


def test_system_end_to_end(spark, tmp_path):
    system = FeatureSystem(spark, Config(str(tmp_path)))
    buys = [("42", "click", None, 0, None, 0), ("42", "purchase", 4.0, 70, None, 1)]
    events = spark.createDataFrame(buys, src.EVENT)
    system.run_batch_features(events)
    system.produce(events)
    system.process_stream()
    assert system.get_feature("feature:user:42:event_count") == "2" and system.get_feature("feature:user:42:window:60:total_purchase_amount") == "4"
    users = spark.createDataFrame([("42",), ("9",)], "user_id string")
    scored = {r.user_id: r for r in system.predict(users, [0, 60]).collect()}
    assert scored["42"].warnings == [] and scored["9"].label == "uncertain"
    assert system.predictions.read().count() == 2 and system.lineage.read().where("user_id = '42'").first().missing_features == []
    system.write_predictions(system.predict(users, [0, 60], record=False))
    assert system.get_feature("prediction:user:9:label") == "uncertain"
    assert sum(r["keys"] for r in system.key_distribution().collect()) == system.cells().count()
    roles = {r.node_id: r.role for r in promoted(system.topology(), "shard-a", "shard-a-follower1").collect()}
    assert (roles["shard-a-leader"], roles["shard-a-follower1"], roles["shard-b-leader"]) == ("follower", "leader", "leader")


def test_all_steps_run(spark, tmp_path):
    from larkspur.run import steps

    results = {name: step() for name, step in steps(spark, str(tmp_path))}
    assert sum(n for _, n in results["placement"]) == 1979 and results["sequences"]["f1"] == 0.5  # known figures
