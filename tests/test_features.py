"""Batch and window features on small fixtures, with their known values."""

import pytest

from larkspur.operators import features as ft
from larkspur.operators.mapreduce import map_reduce
from larkspur.sources.events import EVENT

BATCH = [("42", "click", None), ("42", "click", None), ("42", "purchase", 19.99), ("7", "purchase", 5.0)]


def events(spark, rows):
    return spark.createDataFrame([(u, t, a, (time[0] if time else 0), None, k) for k, (u, t, a, *time) in enumerate(rows)], EVENT)


def cells(df):
    return {r.key: r.value for r in df.collect()}


def test_batch_features(spark):
    got = cells(ft.as_cells(ft.user_features(events(spark, BATCH))))
    assert got == {
        "feature:user:42:event_count": "3", "feature:user:42:click_count": "2", "feature:user:42:purchase_count": "1", "feature:user:42:total_purchase_amount": "19.99",
        "feature:user:7:event_count": "1", "feature:user:7:purchase_count": "1", "feature:user:7:total_purchase_amount": "5",
    }


def test_unknown_types_only_count(spark):
    got = cells(ft.as_cells(ft.user_features(events(spark, [("1", " Click", None), ("1", "signup", 3.0), ("1", "purchase", None)]))))
    assert got == {"feature:user:1:event_count": "3", "feature:user:1:purchase_count": "1", "feature:user:1:total_purchase_amount": "0"}


def test_missing_fields_fail(spark):
    with pytest.raises(Exception, match="event is missing user_id"):
        ft.user_features(events(spark, [(None, "click", None)])).collect()
    with pytest.raises(Exception, match="must not be negative"):
        ft.window_features(events(spark, [("1", "click", None, -5)])).collect()


def test_windows_and_upsert(spark):
    rows = [("42", "click", None, 10), ("42", "click", None, 20), ("42", "purchase", 12.5, 70)]
    got = cells(ft.as_cells(ft.window_features(events(spark, rows))))
    assert got["feature:user:42:window:0:click_count"] == "2"
    assert got["feature:user:42:window:60:total_purchase_amount"] == "12.5"
    first = ft.window_features(events(spark, [("42", "click", None, 5)]))
    second = ft.window_features(events(spark, [("42", "click", None, 30)]))
    assert ft.merged_windows(first, second).first().click_count == 2


def test_serving(spark):
    users = spark.createDataFrame([("42",), ("9",)], "user_id string")
    batch, windows = ft.user_features(events(spark, BATCH)), ft.window_features(events(spark, [("42", "click", None, 10)]))
    got = {r.user_id: r for r in ft.served_features(users, batch, windows, [0, 60]).collect()}
    assert got["42"].missing == [] and got["42"].recent_click_count == 1 and got["42"].recent_windows_with_activity == 1
    assert got["9"].missing == ["event_count", "click_count", "purchase_count", "total_purchase_amount"] and not got["9"].recent_activity_available
    keys = {r.user_id: r for r in ft.served_keys(users, ft.as_cells(windows), [0, 60]).collect()}
    assert keys["42"].recent_source_keys == ["feature:user:42:window:0:event_count", "feature:user:42:window:0:click_count"] and keys["9"].recent_source_keys == []
    assert not ft.served_features(users, batch, windows, []).first().recent_windows_checked


def test_generic_job(spark, tmp_path):
    numbers = spark.createDataFrame([(1,), (2,), (3,), (4,)], "value bigint")
    got = map_reduce(numbers, lambda r: [("odd" if r["value"] % 2 else "even", r["value"])], lambda k, v: sum(v), "key string, value bigint", "key string, total bigint")
    assert {r.key: r.total for r in got.collect()} == {"odd": 4, "even": 6}
    flag = str(tmp_path / "failed")

    def flaky(r):
        import os

        if r["value"] == 3 and not os.path.exists(flag):
            open(flag, "w").close()
            raise ValueError("once")
        return [("k", r["value"])]

    assert map_reduce(numbers, flaky, lambda k, v: sum(v), "key string, value bigint", "key string, total bigint", retries=1).first().total == 10
    with pytest.raises(ValueError, match="retries"):
        map_reduce(numbers, flaky, sum, "key string, value bigint", "key string, total bigint", retries=-1)
