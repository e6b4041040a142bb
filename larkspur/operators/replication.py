"""Replication by shipping a shard's log to its nodes: what each node has applied, barriers, failover, reads, status.

Everything is a function of two tables: writes (shard_id, idx, seq, op, key, value), numbered from 1 on each shard, and nodes
(shard_id, node_id, role, behind), where behind is how many of the last writes an asynchronous node hasn't got yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import snapshot

MODES = ("sync", "async")


def shipped(writes: DataFrame, nodes: DataFrame, mode: str = "sync") -> DataFrame:
    """shard_id, node_id, idx, seq, op, key, value: the log of every node. Leaders have every write, and so has a follower
    in sync mode; in async mode a follower lacks the last `behind` ones."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    own = nodes.select("shard_id", "node_id", F.when((F.col("role") == "leader") | F.lit(mode == "sync"), 0).otherwise(F.col("behind")).alias("_lacks"))
    last = writes.groupBy("shard_id").agg(F.max("idx").alias("_last"))
    reach = own.join(last, "shard_id").select("shard_id", "node_id", (F.col("_last") - F.col("_lacks")).alias("_to"))
    return writes.join(F.broadcast(reach), "shard_id").where("idx <= _to").drop("_to")  # one row for each node


def gapless(log: DataFrame) -> DataFrame:
    """The entries that each node applies: the first of each idx. A gap fails the job, naming the node and the index."""
    first = log.groupBy("shard_id", "node_id", "idx").agg(F.min_by(F.struct("seq", "op", "key", "value"), "seq").alias("e"))
    w = Window.partitionBy("node_id").orderBy("idx")
    expected = F.lag("idx", 1, 0).over(w) + 1
    message = F.concat(F.lit("replication gap on "), F.col("node_id"), F.lit(": expected "), expected.cast("string"), F.lit(", got "), F.col("idx").cast("string"))
    return first.withColumn("idx", F.when(F.col("idx") == expected, F.col("idx")).otherwise(F.raise_error(message).cast("bigint"))).select("shard_id", "node_id", "idx", "e.*")


def barrier(log: DataFrame, nodes: DataFrame, idx: int) -> DataFrame:
    """shard_id, reached, waiting: how many nodes of each shard have applied index idx, and how many haven't."""
    at = log.groupBy("shard_id", "node_id").agg(F.max("idx").alias("last"))
    own = nodes.select("shard_id", "node_id").join(at, ["shard_id", "node_id"], "left")
    done = F.coalesce("last", F.lit(0)) >= idx
    return own.groupBy("shard_id").agg(F.count_if(done).alias("reached"), F.count_if(~done).alias("waiting"))


def status(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """shard_id, node_id, role, last_index, lag (behind the leader), live_keys of every node."""
    last = log.groupBy("shard_id", "node_id").agg(F.max("idx").alias("last"))
    newest = log.groupBy("shard_id", "node_id", "key").agg(F.max_by("op", "idx").alias("op"))
    live = newest.groupBy("shard_id", "node_id").agg(F.count_if(F.col("op") == "put").alias("live"))
    own = nodes.select("shard_id", "node_id", "role").join(last, ["shard_id", "node_id"], "left").join(live, ["shard_id", "node_id"], "left")
    lead = own.where("role = 'leader'").groupBy("shard_id").agg(F.max("last").alias("lead"))
    whole = own.join(F.broadcast(lead), "shard_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return whole.select("shard_id", "node_id", "role", zero("last").alias("last_index"), (zero("lead") - zero("last")).alias("lag"), zero("live").alias("live_keys"))


def read_from(log: DataFrame, node_id: str) -> DataFrame:
    """The live keys that one node shows, be it leader or follower: key, value."""
    return snapshot(log.where(F.col("node_id") == node_id).select(F.col("idx").alias("seq"), "op", "key", "value"))


def writable(nodes: DataFrame, node_id: str) -> None:
    """Only a leader takes writes; anything else is an error."""
    row = nodes.where(F.col("node_id") == node_id).first()
    if row is None:
        raise ValueError(f"unknown node {node_id}")
    if row.role != "leader":
        raise PermissionError(f"{node_id} is a {row.role}: only a leader takes writes")


def failover(nodes: DataFrame, log: DataFrame, shard_id: str | None = None, node_id: str | None = None) -> DataFrame:
    """nodes after the leader of a shard (of every shard) is lost: with role and next_index, the index of the next write.

    The furthest follower leads, of equal ones the first by name; or node_id, which must be a follower of the shard. The old
    leader follows. The log goes on behind what the new leader has applied: writes that it never got are lost.
    """
    if node_id is not None:
        row = nodes.where(F.col("node_id") == node_id).first()
        if row is None or row.role != "follower" or shard_id not in (None, row.shard_id):
            raise ValueError(f"{node_id} is no follower of {shard_id or 'a shard'}")
        shard_id = row.shard_id
    at = log.groupBy("shard_id", "node_id").agg(F.max("idx").alias("last"))
    own = nodes.join(at, ["shard_id", "node_id"], "left").withColumn("last", F.coalesce("last", F.lit(0)))
    asked = (F.col("role") == "follower") if node_id is None else (F.col("node_id") == node_id)
    best = own.where(asked).groupBy("shard_id").agg(F.min(F.struct(-F.col("last"), "node_id")).alias("b")).select("shard_id", F.col("b.node_id").alias("_lead"))
    if shard_id is not None:
        best = best.where(F.col("shard_id") == shard_id)
    led = own.join(F.broadcast(best), "shard_id", "left")
    role = F.when(F.col("_lead").isNull(), F.col("role")).when(F.col("node_id") == F.col("_lead"), "leader").otherwise("follower")
    led = led.withColumn("role", role)
    ahead = led.where("role = 'leader'").groupBy("shard_id").agg((F.max("last") + 1).alias("next_index"))
    return led.join(F.broadcast(ahead), "shard_id", "left").select("shard_id", "node_id", "role", F.col("next_index").cast("bigint").alias("next_index"))
