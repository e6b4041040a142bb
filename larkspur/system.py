"""The whole engine behind one object."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import features, intent
from .operators.ring import Ring, hotspots, per_shard, routed
from .operators.store import Table
from .sources.events import EventLog
from .sources.records import LINEAGE, Records
from .streaming.processor import process_available


@dataclass(frozen=True)
class Config:
    path: str
    shards: tuple[str, ...] = ("shard-a", "shard-b")
    replicas: tuple[str, ...] = ("leader", "follower1", "follower2")
    nodes: int = 8
    window: int = 60
    group: str = "feature-updater"
    compact_after: int = 4


class FeatureSystem:
    """Batch and stream features, their store and placement, serving and predictions, under one folder."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.ring = Ring(config.shards, config.nodes)
        self.store = Table(spark, f"{config.path}/store", config.compact_after)
        self.log = EventLog(spark, f"{config.path}/events")
        self.predictions = Records(spark, f"{config.path}/predictions")
        self.lineage = Records(spark, f"{config.path}/lineage", LINEAGE)

    def run_batch_features(self, events: DataFrame) -> DataFrame:
        """Compute and store the features of all history; the cells that were written."""
        cells = features.as_cells(features.user_features(events))
        self.store.write(cells)
        return cells

    def produce(self, events: DataFrame) -> int:
        return self.log.append(events)

    def process_stream(self, **options) -> None:
        process_available(self.log, self.store, f"{self.config.path}/checkpoints/{self.config.group}", self.config.window, **options)

    def cells(self) -> DataFrame:
        """Live feature cells."""
        return self.store.snapshot().where(~F.col("key").startswith("stream:"))

    def get_feature(self, key: str) -> str | None:
        return self.store.get(key)

    def wide(self) -> tuple[DataFrame, DataFrame]:
        """The stored cells as wide tables of batch and of window features."""
        parts = F.split("key", ":")
        rows = self.cells().where(F.col("key").startswith("feature:user:")).select(
            F.regexp_extract("key", r"^feature:user:(.*?)(?::window:(\d+))?:([a-z_]+)$", 1).alias("user_id"), F.regexp_extract("key", r":window:(\d+):[a-z_]+$", 1).alias("w"),
            F.element_at(parts, -1).alias("feature"), F.col("value").cast("double").alias("value"),
        )
        columns = [F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features.BATCH_FEATURES]
        batch = rows.where("w = ''").groupBy("user_id").agg(*columns)
        windows = rows.where("w <> ''").groupBy("user_id", F.col("w").cast("bigint").alias("window_start")).agg(*columns)
        return batch, windows

    def predict(self, users: DataFrame, starts: list[int], model: intent.IntentModel | None = None, record: bool = True) -> DataFrame:
        """Serve, score, and append predictions and their lineage."""
        batch, windows = self.wide()
        served = features.served_features(users, batch, windows, starts)
        scored = (model or intent.IntentModel()).predict(served)
        if record:
            scored = scored.persist()
            self.predictions.append(scored)
            self.lineage.append(intent.prediction_lineage(scored, features.served_keys(users, self.cells(), starts)))
        return scored

    def write_predictions(self, scored: DataFrame) -> None:
        self.store.write(intent.prediction_cells(scored))

    def key_distribution(self) -> DataFrame:
        return per_shard(routed(self.cells(), self.ring), self.ring, "keys")

    def hotspot_report(self, requests: DataFrame) -> DataFrame:
        """Requests (rows with a key) by shard."""
        return hotspots(per_shard(routed(requests, self.ring), self.ring, "requests"))

    def topology(self) -> DataFrame:
        """shard_id, node_id, role of every replica; the first of a shard leads."""
        rows = [(s, f"{s}-{r}", "leader" if k == 0 else "follower") for s in self.config.shards for k, r in enumerate(self.config.replicas)]
        return self.spark.createDataFrame(rows, "shard_id string, node_id string, role string")


def promoted(topology: DataFrame, shard_id: str, node_id: str) -> DataFrame:
    """The topology after a failover: node_id leads its shard, the old leader follows. An unknown node is an error."""
    if topology.where((F.col("shard_id") == shard_id) & (F.col("node_id") == node_id)).isEmpty():
        raise ValueError(f"{shard_id} has no node {node_id}")
    mine = F.col("shard_id") == shard_id
    return topology.withColumn("role", F.when(~mine, F.col("role")).when(F.col("node_id") == node_id, "leader").otherwise("follower"))
