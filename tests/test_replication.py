"""Logs shipped to nodes, barriers, failover, guards; sharded stores, write-ahead logs, value text."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import scalar as fn
from larkspur.operators import replication as rp
from larkspur.operators import sharded as sh
from larkspur.operators import store as st
from larkspur.operators.ring import Ring


@pytest.fixture
def tables(spark):
    writes = [("s", 1, 1, "put", "a", "1"), ("s", 2, 2, "put", "b", "2"), ("s", 3, 3, "del", "a", None), ("s", 4, 4, "put", "c", "3")]
    nodes = [("s", "n0", "leader", 0), ("s", "n1", "follower", 2), ("s", "n2", "follower", 1)]
    return spark.createDataFrame(writes, "shard_id string, idx bigint, seq bigint, op string, key string, value string"), spark.createDataFrame(nodes, "shard_id string, node_id string, role string, behind int")


def live(df):
    return {r.key: r.value for r in df.collect()}


def test_sync_and_async(tables):
    writes, nodes = tables
    sync, late = rp.shipped(writes, nodes), rp.shipped(writes, nodes, "async")
    assert all(live(rp.read_from(rp.gapless(sync), n)) == {"b": "2", "c": "3"} for n in ("n0", "n1", "n2"))
    assert live(rp.read_from(late, "n1")) == {"a": "1", "b": "2"} and live(rp.read_from(late, "n2")) == {"b": "2"}
    assert sorted((r.node_id, r.last_index, r.lag, r.live_keys) for r in rp.status(late, nodes).collect()) == [("n0", 4, 0, 2), ("n1", 2, 2, 2), ("n2", 3, 1, 1)]
    assert [tuple(r) for r in rp.barrier(late, nodes, 3).collect()] == [("s", 2, 1)]
    with pytest.raises(ValueError):
        rp.shipped(writes, nodes, "maybe")


def test_a_gap_is_an_error(tables):
    writes, nodes = tables
    with pytest.raises(Exception, match="replication gap on n.: expected 2, got 3"):
        rp.gapless(rp.shipped(writes, nodes).where("idx <> 2")).collect()


def test_failover(tables):
    writes, nodes = tables
    late = rp.shipped(writes, nodes, "async")
    assert sorted((r.node_id, r.role, r.next_index) for r in rp.failover(nodes, late).collect()) == [("n0", "follower", 4), ("n1", "follower", 4), ("n2", "leader", 4)]
    assert {(r.node_id, r.role, r.next_index) for r in rp.failover(nodes, late, "s", "n1").collect()} >= {("n1", "leader", 3), ("n2", "follower", 3)}
    for wrong in ("n9", "n0"):
        with pytest.raises(ValueError):
            rp.failover(nodes, late, "s", wrong)
    rp.writable(nodes, "n0")
    with pytest.raises(PermissionError):
        rp.writable(nodes, "n1")


def test_wal(spark, tmp_path):
    wal = sh.Wal(spark, str(tmp_path / "wal"))
    assert wal.replay().count() == 0
    wal.append(spark.createDataFrame([(2, "del", "a", None), (1, "put", "a", "1")], st.CHANGE))
    (tmp_path / "wal" / "part-x.json").write_text('\n{"seq": 3, "op": "put", "key": "b", "value": "2"}\n\n')
    assert wal.replay().count() == 3 and wal.replay(2).count() == 1
    table = st.Table(spark, str(tmp_path / "t"))
    table.restore(wal.replay())
    table.restore(wal.replay())
    assert live(st.Table(spark, str(tmp_path / "t")).snapshot()) == {"b": "2"}
    with pytest.raises(Exception, match="unknown op"):
        wal.append(spark.createDataFrame([(1, "merge", "a", "1")], st.CHANGE))


def test_sharded_store(spark, tmp_path):
    ring = Ring(("a", "b"), 8)
    store = sh.ShardedStore(spark, str(tmp_path), ring)
    keys = {f"user:{k}": str(k) for k in range(40)}
    store.write(spark.createDataFrame(list(keys.items()), "key string, value string"))
    store.delete("user:3")
    store.put("user:4", "four")
    want = {k: v for k, v in keys.items() if k != "user:3"} | {"user:4": "four"}
    assert live(store.snapshot()) == want and store.get("user:3") is None and store.get("user:4") == "four"
    before = {r.key: r.shard_id for r in store.snapshot().collect()}
    moved = store.add_shard("c")
    after = {r.key: r.shard_id for r in store.snapshot().collect()}
    assert moved == sum(before[k] != after[k] for k in after) > 0 and all(after[k] in (before[k], "c") for k in after) and live(store.snapshot()) == want
    assert all(store.owner(k) == s for k, s in list(after.items())[:5])


def test_the_last_of_repeated_keys_wins(spark, tmp_path):
    table = st.Table(spark, str(tmp_path / "t"))
    table.write(spark.createDataFrame([("a", "10", 1), ("a", "9", 2), ("b", "1", 1), ("b", None, 2)], "key string, value string, at int"), order="at")
    assert live(table.snapshot()) == {"a": "9"}


def test_old_snapshots_outlive_a_compaction(spark, tmp_path):
    table = st.Table(spark, str(tmp_path / "t"), compact_after=2)
    table.write(spark.createDataFrame([("a", "1")], "key string, value string"))
    old = table.snapshot()
    table.write(spark.createDataFrame([("a", "2")], "key string, value string"))
    assert live(old) == {"a": "1"} and live(table.snapshot()) == {"a": "2"}


def test_value_text(spark):
    values = {0.12345: "0.12345", 12.5: "12.5", 4.0: "4", 100.0: "100", 1e7: "10000000", 12345678.9: "12345678.9", 1e-5: "0.00001", -0.5: "-0.5", 0.1 + 0.2: "0.30000000000000004", None: "0"}
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", fn.format_value(F.col("v")).alias("t"))
    assert [r.t for r in rows.orderBy("k").collect()] == list(values.values())


def test_numerals(spark):
    texts = ["1d", "1f", "0x1p3", "1_000", "1__0", " 2.5 ", "nan", "Infinity", "-1e5", "", "x", "5.", ".5", "."]

    def known(t):
        try:
            float(t)
        except ValueError:
            return False
        return True

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.is_number(F.col("t")).alias("ok"), fn.number(F.col("t")).alias("n")).collect()
    assert {r.t: r.ok for r in got} == {t: known(t) for t in texts} and all(r.n == float(r.t) for r in got if r.ok and r.t != "nan")
