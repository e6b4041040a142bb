"""A store of several shards: writes go to the shard that owns their key, with a write-ahead log in front of each table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ring import Ring, routed
from .store import CHANGE, Table, checked_ops


class Wal:
    """Changes as JSON lines, one file or more for each append. Replay is by sequence number; blank lines are skipped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, changes: DataFrame) -> None:
        """Append changes (seq, op, key, value); they are on disk when this returns."""
        checked_ops(changes).select("seq", "op", "key", "value").write.mode("append").json(self.path)

    def replay(self, after: int = 0) -> DataFrame:
        """Changes with a sequence number beyond `after`, as far as they were written."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], CHANGE)
        lines = self.spark.read.text(self.path).where(F.trim("value") != "")
        return checked_ops(lines.select(F.from_json("value", CHANGE, {"mode": "FAILFAST"}).alias("c")).select("c.*")).where(F.col("seq") > after)


class ShardedStore:
    """One Table for each shard of a ring, under a folder."""

    def __init__(self, spark: SparkSession, path: str, ring: Ring, compact_after: int = 4):
        self.spark, self.path, self.ring, self.compact_after = spark, path, ring, compact_after
        self.tables = {s: self._table(s) for s in ring.shards}

    def _table(self, shard: str) -> Table:
        return Table(self.spark, f"{self.path}/{shard}", self.compact_after)

    def write(self, cells: DataFrame) -> None:
        """Put (key, value) cells into the shards that own them; a null value deletes its key."""
        placed = routed(cells, self.ring).persist()
        try:
            for shard, table in self.tables.items():
                table.write(placed.where(F.col("shard_id") == shard).drop("shard_id"))
        finally:
            placed.unpersist()

    def owner(self, key: str) -> str:
        return routed(self.spark.createDataFrame([(key,)], "key string"), self.ring).first().shard_id

    def put(self, key: str, value: str) -> None:
        self.tables[self.owner(key)].write(self.spark.createDataFrame([(key, value)], "key string, value string"))

    def delete(self, key: str) -> None:
        self.tables[self.owner(key)].write(self.spark.createDataFrame([(key, None)], "key string, value string"))

    def get(self, key: str) -> str | None:
        return self.tables[self.owner(key)].get(key)

    def snapshot(self) -> DataFrame:
        """shard_id, key, value of every live key, by the shard that holds it."""
        parts = [t.snapshot().select(F.lit(s).alias("shard_id"), "key", "value") for s, t in self.tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def add_shard(self, shard: str) -> int:
        """Add a shard and move the keys that it owns from now on; how many moved. The new shard has them before the old
        ones lose them, so a crash in between leaves copies that the next call removes, and no gap."""
        grown = self.ring.with_shard(shard)
        tables = {**self.tables, shard: self._table(shard)}
        moved = self.snapshot().withColumn("to", grown.owner(F.col("key"))).where(F.col("to") == shard).persist()
        try:
            count = moved.count()
            tables[shard].write(moved.select("key", "value"))
            for old, table in self.tables.items():
                gone = moved.where(F.col("shard_id") == old)
                table.write(gone.select("key", F.lit(None).cast("string").alias("value")))
        finally:
            moved.unpersist()
        self.ring, self.tables = grown, tables
        return count
