"""Queries over keys and changes: the ring, placement, the latest-value store, replication, the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import replication as rp
from ..operators import ring as rg
from ..operators import sharded as sh
from ..operators import store as st
from ..sources import events as src
from . import rounded as rd
from . import sql
from .registry import query
from ..sources.shared import new_folder

TWO, THREE = ("shard-a", "shard-b"), ("shard-a", "shard-b", "shard-c")
OLD, NEW = rg.Ring(TWO, 8), rg.Ring(THREE, 8)
_RING = sql.ring(TWO, 8)
_KEYS = f"{sql.WIDE}, {_RING}, keys AS ({sql.BATCH_CELLS})"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return ft.as_cells(rd.user_features(src.table_events(spark, d)))


@query(f"WITH {_RING} SELECT * FROM ring")
def ring_tokens(spark: SparkSession, d: str) -> DataFrame:
    return OLD.table(spark)


@query(f"WITH {_RING} SELECT DISTINCT shard_id FROM ring ORDER BY shard_id")
def ring_shards(spark: SparkSession, d: str) -> DataFrame:
    return OLD.table(spark).select("shard_id").distinct().orderBy("shard_id")


@query(f"WITH {_KEYS} SELECT key, shard_id FROM {sql.routed('keys')}")
def route_keys(spark: SparkSession, d: str) -> DataFrame:
    return rg.routed(_cells(spark, d).select("key"), OLD)


@query(f"WITH {_KEYS} SELECT s.shard_id, count(k.key) AS keys FROM (SELECT DISTINCT shard_id FROM ring) s LEFT JOIN {sql.routed('keys')} k USING (shard_id) GROUP BY ALL")
def key_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rg.per_shard(rg.routed(_cells(spark, d), OLD), OLD, "keys")


_PRESSURE = f"{sql.EV}, {_RING}, keys AS (SELECT pos, 'feature:user:' || user_id || ':window:' || (t - t % 60) || ':event_count' AS key FROM ev)"


@query(f"WITH {_PRESSURE} SELECT shard_id, count(*) AS events FROM {sql.routed('keys')} GROUP BY ALL")
def event_pressure(spark: SparkSession, d: str) -> DataFrame:
    """Events by the shard of their window's count, before any aggregation."""
    from ..functions.scalar import window_key, window_start

    keys = src.table_events(spark, d).select(window_key(F.col("user_id"), window_start(F.col("timestamp")), F.lit("event_count")).alias("key"))
    return rg.per_shard(rg.routed(keys, OLD), OLD, "events")


_REQUESTS = f"{sql.EV}, {sql.windows(60)}, {_RING}, cells AS ({sql.WINDOW_CELLS}), keys AS (SELECT key, n FROM cells, range(2) r(n))"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """An update of a window cell reads it and writes it."""
    cells = ft.as_cells(rd.window_features(src.table_events(spark, d)))
    return cells.select("key", F.explode(F.array(F.lit("get"), F.lit("put"))).alias("op"))


@query(f"WITH {_REQUESTS} SELECT shard_id, count(*) AS requests FROM {sql.routed('keys')} GROUP BY ALL")
def request_counts(spark: SparkSession, d: str) -> DataFrame:
    return rg.per_shard(rg.routed(_requests(spark, d), OLD), OLD, "requests")


@query(f"WITH {_REQUESTS} SELECT shard_id, count(*) AS requests FROM {sql.routed('keys')} GROUP BY ALL ORDER BY requests DESC, shard_id")
def hotspot_report(spark: SparkSession, d: str) -> DataFrame:
    return rg.hotspots(rg.per_shard(rg.routed(_requests(spark, d), OLD), OLD, "requests"))


@query(f"WITH {_KEYS}, {sql.ring(THREE, 8, 'ring3')} SELECT a.key, a.shard_id AS from_shard, b.shard_id AS to_shard FROM {sql.routed('keys')} a JOIN {sql.routed('keys', 'ring3')} b USING (key) WHERE a.shard_id <> b.shard_id")
def rebalance_plan(spark: SparkSession, d: str) -> DataFrame:
    return rg.rebalance_plan(_cells(spark, d), OLD, NEW)


_CHANGES = "ch AS (SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'del' ELSE 'put' END AS op, CAST(o_custkey AS VARCHAR) AS key, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS value FROM orders)"
_LATEST = f"{_CHANGES}, latest AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    gone = F.col("o_orderstatus") == "F"
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.when(gone, "del").otherwise("put").alias("op"), F.col("o_custkey").cast("string").alias("key"), F.when(~gone, F.col("o_orderpriority")).alias("value"))


@query(f"WITH {_LATEST} SELECT * FROM latest")
def compacted_store(spark: SparkSession, d: str) -> DataFrame:
    return st.latest(_changes(spark, d))


@query(f"WITH {_LATEST} SELECT key, value FROM latest WHERE op = 'put'")
def store_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return st.snapshot(_changes(spark, d))


@query(f"WITH {_LATEST} SELECT key, value FROM latest WHERE op = 'put' AND key = '7'")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return st.lookup(_changes(spark, d), "7")


@query(f"WITH {_LATEST} SELECT op, count(*) AS keys, max(seq) + 1 AS next_seq FROM latest GROUP BY op")
def latest_value(spark: SparkSession, d: str) -> DataFrame:
    return st.latest(_changes(spark, d)).groupBy("op").agg(F.count("*").alias("keys"), (F.max("seq") + 1).alias("next_seq"))


_WRITES = f"{_CHANGES}, {_RING}, wr AS (SELECT seq, key, shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY seq) AS idx FROM {sql.routed('ch')})"


def _writes(spark: SparkSession, d: str) -> DataFrame:
    return st.write_indexes(rg.routed(_changes(spark, d), OLD)).select("seq", "key", "shard_id", "idx")


@query(f"WITH {_WRITES} SELECT * FROM wr")
def replication_log(spark: SparkSession, d: str) -> DataFrame:
    return _writes(spark, d)


_APPLIED = f"{_WRITES}, app AS (SELECT shard_id, shard_id || '-' || n AS node_id, idx FROM (SELECT *, max(idx) OVER (PARTITION BY shard_id) AS mx FROM wr), (VALUES ('follower1', 97, 90), ('follower2', 89, 95)) v(n, m, pct) WHERE idx % m <> 0 AND 100 * idx <= pct * mx)"


def _applied(spark: SparkSession, d: str) -> DataFrame:
    """What two followers of each shard have got: each has missed some writes all along, and is behind by a share of them."""
    followers = spark.createDataFrame([("follower1", 97, 90), ("follower2", 89, 95)], "n string, m int, pct int")
    writes = _writes(spark, d)
    last = writes.groupBy("shard_id").agg(F.max("idx").alias("mx"))  # one row for each shard
    rows = writes.join(F.broadcast(last), "shard_id").crossJoin(F.broadcast(followers)).where("idx % m <> 0 and 100 * idx <= pct * mx")  # two rows
    return rows.select("shard_id", F.concat_ws("-", "shard_id", "n").alias("node_id"), "idx")


@query(f"WITH {_APPLIED} SELECT node_id, expected, idx FROM (SELECT node_id, idx, lag(idx, 1, 0) OVER (PARTITION BY node_id ORDER BY idx) + 1 AS expected FROM app) WHERE idx <> expected")
def replication_gaps(spark: SparkSession, d: str) -> DataFrame:
    return st.replication_gaps(_applied(spark, d))


_LAG = f"{_APPLIED}, lg AS (SELECT shard_id, node_id, max(idx) AS applied, (SELECT max(idx) FROM wr WHERE wr.shard_id = app.shard_id) - max(idx) AS lag FROM app GROUP BY shard_id, node_id)"


@query(f"WITH {_LAG} SELECT * FROM lg")
def replica_lag(spark: SparkSession, d: str) -> DataFrame:
    return st.replica_lag(_writes(spark, d), _applied(spark, d))


@query(f"WITH {_LAG} SELECT shard_id, node_id, lag FROM lg QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY lag, node_id) = 1")
def most_up_to_date_follower(spark: SparkSession, d: str) -> DataFrame:
    return st.most_up_to_date(st.replica_lag(_writes(spark, d), _applied(spark, d)))


@query(f"WITH {_APPLIED} SELECT node_id, count(*) AS taken FROM (SELECT node_id, idx, row_number() OVER (PARTITION BY node_id ORDER BY idx) AS n FROM app) WHERE idx = n GROUP BY node_id")
def replication_applied(spark: SparkSession, d: str) -> DataFrame:
    twice = _applied(spark, d).withColumn("op", F.lit("put")).withColumn("key", F.lit("k")).withColumn("value", F.lit("v"))
    both = twice.withColumn("arrival", F.lit(1)).union(twice.withColumn("arrival", F.lit(2)))
    return st.applicable(both).groupBy("node_id").agg(F.count("*").alias("taken"))


_NODES = [(s, f"{s}-{n}", role, behind) for s in TWO for n, role, behind in (("leader", "leader", 0), ("follower1", "follower", 25), ("follower2", "follower", 10))]
_SHIP = f"""{_CHANGES}, {_RING}, wr AS (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY seq) AS idx FROM {sql.routed('ch')}), nd AS (SELECT * FROM (VALUES {', '.join(map(str, _NODES))}) v(shard_id, node_id, role, behind)),
  sync AS (SELECT shard_id, node_id, idx, seq, op, key, value FROM wr JOIN nd USING (shard_id)),
  late AS (SELECT shard_id, node_id, idx, seq, op, key, value FROM (SELECT *, max(idx) OVER (PARTITION BY shard_id) AS mx FROM wr) JOIN nd USING (shard_id) WHERE idx <= mx - behind)"""


def _nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_NODES, "shard_id string, node_id string, role string, behind int")


def _shipped(spark: SparkSession, d: str, mode: str) -> DataFrame:
    return rp.shipped(st.write_indexes(rg.routed(_changes(spark, d), OLD)), _nodes(spark), mode)


@query(f"WITH {_SHIP} SELECT node_id, key, value FROM (SELECT * FROM sync QUALIFY row_number() OVER (PARTITION BY node_id, key ORDER BY idx DESC) = 1) WHERE op = 'put'")
def replicate_sync(spark: SparkSession, d: str) -> DataFrame:
    """Every node's live keys when all writes have been shipped: the same on all nodes of a shard."""
    log = rp.gapless(_shipped(spark, d, "sync"))
    newest = log.groupBy("node_id", "key").agg(F.max(F.struct("idx", "op", "value")).alias("v"))
    return newest.where("v.op = 'put'").select("node_id", "key", "v.value")


_STATUS = """SELECT shard_id, node_id, role, last_index, max(last_index) FILTER (role = 'leader') OVER (PARTITION BY shard_id) - last_index AS lag, live_keys
  FROM nd JOIN (SELECT node_id, max(idx) AS last_index FROM late GROUP BY node_id) USING (node_id)
  JOIN (SELECT node_id, count(*) FILTER (op = 'put') AS live_keys FROM (SELECT * FROM late QUALIFY row_number() OVER (PARTITION BY node_id, key ORDER BY idx DESC) = 1) GROUP BY node_id) USING (node_id)"""


@query(f"WITH {_SHIP} {_STATUS}")
def replicate_async_lag(spark: SparkSession, d: str) -> DataFrame:
    """Status of every node while followers lag."""
    return rp.status(_shipped(spark, d, "async"), _nodes(spark))


@query(f"WITH {_SHIP}, ap AS (SELECT shard_id, node_id, max(idx) AS last FROM late GROUP BY ALL) SELECT shard_id, count(*) FILTER (last >= 600) AS reached, count(*) FILTER (last < 600) AS waiting FROM ap GROUP BY shard_id")
def replication_barrier(spark: SparkSession, d: str) -> DataFrame:
    """The feature is a barrier at one index: which nodes have reached write 600."""
    return rp.barrier(_shipped(spark, d, "async"), _nodes(spark), 600)


@query(f"""WITH {_SHIP}, ap AS (SELECT shard_id, node_id, max(idx) AS last FROM late GROUP BY ALL), up AS (SELECT shard_id, node_id AS lead, last FROM ap JOIN nd USING (shard_id, node_id) WHERE role = 'follower' QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY last DESC, node_id) = 1)
  SELECT shard_id, node_id, CASE WHEN node_id = lead THEN 'leader' ELSE 'follower' END AS role, last + 1 AS next_index FROM nd JOIN up USING (shard_id)""")
def failover(spark: SparkSession, d: str) -> DataFrame:
    """Roles and the next index after every leader is lost while followers lag."""
    return rp.failover(_nodes(spark), _shipped(spark, d, "async"))


@query(f"WITH {_SHIP} SELECT key, value FROM (SELECT * FROM late WHERE node_id = 'shard-a-follower1' QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx DESC) = 1) WHERE op = 'put'")
def follower_reads(spark: SparkSession, d: str) -> DataFrame:
    return rp.read_from(_shipped(spark, d, "async"), "shard-a-follower1")


@query(f"WITH {_LATEST} SELECT key, value FROM latest WHERE op = 'put'")
def wal_replay(spark: SparkSession, d: str) -> DataFrame:
    """The changes appended to a log in two parts, the later one first, replayed, and written as a table that is reopened."""
    folder = new_folder(spark, "store")
    wal = sh.Wal(spark, f"{folder}/wal")
    changes = _changes(spark, d)
    for late in (True, False):
        wal.append(changes.where((F.col("seq") % 2 == 0) == F.lit(late)))
    st.Table(spark, f"{folder}/table").restore(wal.replay())
    return st.Table(spark, f"{folder}/table").snapshot()


_MOVED = f"{_KEYS}, {sql.ring(THREE, 8, 'ring3')}"


@query(f"WITH {_MOVED} SELECT r.shard_id, r.key, r.value FROM {sql.routed('keys', 'ring3')} r WHERE r.key NOT LIKE '%:click_count'")
def routed_store(spark: SparkSession, d: str) -> DataFrame:
    """Cells written to two shards, some deleted, then a third shard added: what each shard holds."""
    store = sh.ShardedStore(spark, f"{new_folder(spark, "store")}/store", OLD)
    cells = _cells(spark, d)
    store.write(cells)
    store.write(cells.where("key like '%:click_count'").select("key", F.lit(None).cast("string").alias("value")))
    store.add_shard("shard-c")
    return store.snapshot()


@query(f"WITH {sql.EV} SELECT pos AS \"offset\", user_id, event_type FROM ev WHERE pos >= 500 ORDER BY pos LIMIT 100")
def log_range_scan(spark: SparkSession, d: str) -> DataFrame:
    """The feature is a bounded poll: 100 records from offset 500."""
    log = src.table_events(spark, d).withColumnRenamed("pos", "offset")
    return src.log_range(log.select("offset", "user_id", "event_type"), 500, 100)


@query(f"WITH {sql.EV} SELECT 'group-' || g AS group_id, max(pos) + 1 AS next_offset FROM ev, range(3) r(g) WHERE pos % 3 <= g GROUP BY ALL")
def consumer_offsets(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.range(3).withColumnRenamed("id", "g")
    read = src.table_events(spark, d).select("pos").crossJoin(F.broadcast(groups)).where("pos % 3 <= g")  # three rows
    return read.groupBy(F.concat(F.lit("group-"), F.col("g").cast("string")).alias("group_id")).agg((F.max("pos") + 1).alias("next_offset"))


def _made_sql(n: int, user: str, step: int, amount: float) -> str:
    return f"made AS (SELECT i AS pos, CAST({user} AS VARCHAR) AS user_id, CASE WHEN i % {step} = 0 THEN 'purchase' ELSE 'click' END AS event_type, CASE WHEN i % {step} = 0 THEN {amount}::DOUBLE END AS amount, i AS t FROM range({n}) r(i))"


def _workload_sql(n: int) -> str:
    user = f"i % {max(25, n // 20)}"
    batch, stream = _made_sql(n, user, 5, 10.0).replace("made", "mb", 1), _made_sql(n, user, 7, 5.0).replace("made", "ms", 1)
    return f"""{batch}, {stream}, {_RING}, wide AS (SELECT user_id, {sql.AGGREGATES} FROM mb GROUP BY user_id), win AS (SELECT user_id, t - t % 60 AS window_start, {sql.AGGREGATES} FROM ms GROUP BY ALL),
  keys AS ({sql.BATCH_CELLS} UNION ALL {sql.WINDOW_CELLS})"""


@query(" UNION ALL ".join(f"(WITH {_workload_sql(n)} SELECT {n} AS events, shard_id, count(*) AS keys FROM {sql.routed('keys')} GROUP BY ALL)" for n in (250, 1000, 2500)))
def scaling_workload(spark: SparkSession, d: str) -> DataFrame:
    """Keys by shard after a batch and a stream run over made events of three sizes."""
    out = None
    for n in (250, 1000, 2500):
        cells = ft.as_cells(rd.user_features(src.made_batch_events(spark, n))).union(ft.as_cells(rd.window_features(src.made_stream_events(spark, n))))
        part = rg.per_shard(rg.routed(cells, OLD), OLD, "keys").select(F.lit(n).alias("events"), "shard_id", "keys")
        out = part if out is None else out.union(part)
    return out


def _hot_sql(name: str, user: str) -> str:
    made = f"made AS (SELECT i AS pos, {user} AS user_id, 'click' AS event_type, NULL::DOUBLE AS amount, i AS t FROM range(1000) r(i))"
    return f"""(WITH {made}, {_RING}, win AS (SELECT user_id, t - t % 60 AS window_start, {sql.AGGREGATES} FROM made GROUP BY ALL), cells AS ({sql.WINDOW_CELLS}), ev_keys AS (SELECT pos, 'feature:user:' || user_id || ':window:' || (t - t % 60) || ':event_count' AS key FROM made)
  SELECT '{name}' AS workload, a.shard_id, a.events, b.keys, 2 * b.keys AS requests FROM (SELECT shard_id, count(*) AS events FROM {sql.routed('ev_keys')} GROUP BY ALL) a JOIN (SELECT shard_id, count(*) AS keys FROM {sql.routed('cells')} GROUP BY ALL) b USING (shard_id))"""


@query(_hot_sql("balanced", "CAST(i % 100 AS VARCHAR)") + " UNION ALL " + _hot_sql("skewed", "CASE WHEN i % 10 < 8 THEN 'hot-user' ELSE CAST(i % 100 AS VARCHAR) END"))
def hotspot_workload(spark: SparkSession, d: str) -> DataFrame:
    """Pressure, keys and requests by shard, of users in turn and of one hot user."""
    from ..functions.scalar import window_key, window_start

    out = None
    for name, hot in (("balanced", False), ("skewed", True)):
        made = src.made_clicks(spark, 1000, hot)
        raw = made.select(window_key(F.col("user_id"), window_start(F.col("timestamp")), F.lit("event_count")).alias("key"))
        cells = ft.as_cells(rd.window_features(made))
        both = rg.per_shard(rg.routed(raw, OLD), OLD, "events").join(rg.per_shard(rg.routed(cells, OLD), OLD, "keys"), "shard_id")
        part = both.select(F.lit(name).alias("workload"), "shard_id", "events", "keys", (F.col("keys") * 2).alias("requests"))
        out = part if out is None else out.union(part)
    return out
