"""A consistent-hash ring: placement of keys, skew, and what moves when shards are added."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import let, ring_token


class Ring:
    """Shards at `nodes` places each. The ring is a small driver-side table, whatever the number of keys."""

    def __init__(self, shards: list[str] | tuple[str, ...], nodes: int = 16):
        if nodes <= 0:
            raise ValueError("a shard needs at least one place")
        if len(set(shards)) != len(shards):
            raise ValueError("shards must be distinct")
        self.shards, self.nodes = list(shards), nodes
        places = [(hashlib.md5(f"{s}::{n}".encode()).hexdigest(), s, n) for s in shards for n in range(nodes)]
        self.places = sorted(places)

    def with_shard(self, shard: str) -> Ring:
        return Ring([*self.shards, shard], self.nodes)

    def without_shard(self, shard: str) -> Ring:
        if shard not in self.shards:
            raise ValueError(f"unknown shard {shard}")
        return Ring([s for s in self.shards if s != shard], self.nodes)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.places, "token string, shard_id string, virtual_node int")

    def owner(self, key: Column) -> Column:
        """The shard of the first place at or after the key's token, around the end if there is none."""
        if not self.places:
            raise ValueError("the ring has no shards")
        tokens, names = (F.array(*[F.lit(p[k]) for p in self.places]) for k in (0, 1))
        # the token is computed once, not for each place of the ring
        return let(ring_token(key), lambda token: F.get(names, F.size(F.filter(tokens, lambda t: t < token)) % len(self.places)))


def routed(keys: DataFrame, ring: Ring, key: str = "key") -> DataFrame:
    return keys.withColumn("shard_id", ring.owner(F.col(key)))


def per_shard(placed: DataFrame, ring: Ring, name: str) -> DataFrame:
    """Rows on each shard of the ring, 0 where there are none."""
    counts = placed.groupBy("shard_id").agg(F.count("*").alias(name))
    shards = placed.sparkSession.createDataFrame([(s,) for s in ring.shards], "shard_id string")
    return shards.join(counts, "shard_id", "left").select("shard_id", F.coalesce(name, F.lit(0)).cast("bigint").alias(name))


def hotspots(requests: DataFrame) -> DataFrame:
    """Shards by requests, the busiest first."""
    return requests.orderBy(F.desc("requests"), "shard_id")


def rebalance_plan(keys: DataFrame, old: Ring, new: Ring, key: str = "key") -> DataFrame:
    """Keys whose owner changes: key, from_shard, to_shard."""
    placed = keys.select(key, old.owner(F.col(key)).alias("from_shard"), new.owner(F.col(key)).alias("to_shard"))
    return placed.where("from_shard <> to_shard")
