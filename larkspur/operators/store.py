"""A latest-value table over a changelog (seq, op, key, value): snapshots, compaction, replication checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numbering import numbered

CHANGE = "seq bigint, op string, key string, value string"


def checked_ops(changes: DataFrame) -> DataFrame:
    """The changes; an operation other than put and del fails the job."""
    bad = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("string")
    return changes.withColumn("op", F.when(F.col("op").isin("put", "del"), F.col("op")).otherwise(bad))


def latest(changes: DataFrame) -> DataFrame:
    """The newest version of each key, deletions included. One aggregate, combined before the shuffle."""
    newest = checked_ops(changes).groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("v"))
    return newest.select("v.seq", "v.op", "key", "v.value")


def snapshot(changes: DataFrame) -> DataFrame:
    """Live keys: key, value."""
    return latest(changes).where("op = 'put'").select("key", "value")


def lookup(changes: DataFrame, key: str) -> DataFrame:
    """The live value of one key; the filter reaches the scan."""
    return snapshot(changes.where(F.col("key") == key))


def write_indexes(writes: DataFrame, by: str = "shard_id", order: str = "seq") -> DataFrame:
    """Writes numbered from 1 on each shard."""
    return numbered(writes, [order], "idx", by=[by])


def replication_gaps(applied: DataFrame) -> DataFrame:
    """Where a node's indexes (node_id, idx) aren't consecutive from 1: node_id, expected, idx. Repeated ones don't count."""
    before = F.lag("idx", 1, 0).over(Window.partitionBy("node_id").orderBy("idx"))
    seen = applied.select("node_id", "idx").distinct().withColumn("expected", before + 1)
    return seen.where("idx <> expected").select("node_id", F.col("expected").cast("bigint").alias("expected"), F.col("idx").cast("bigint").alias("idx"))


def applicable(applied: DataFrame) -> DataFrame:
    """The log entries that each node takes: the first of each index, up to the first gap."""
    first = applied.groupBy("node_id", "idx").agg(F.min_by(F.struct("op", "key", "value"), "arrival").alias("e"))
    n = F.row_number().over(Window.partitionBy("node_id").orderBy("idx"))
    return first.withColumn("n", n).where("idx = n").select("node_id", "idx", "e.op", "e.key", "e.value")


def replica_lag(written: DataFrame, applied: DataFrame) -> DataFrame:
    """How far each node (shard_id, node_id, idx) is behind its shard's writes (shard_id, idx)."""
    last = written.groupBy("shard_id").agg(F.max("idx").alias("last"))
    own = applied.groupBy("shard_id", "node_id").agg(F.max("idx").alias("applied"))
    return own.join(last, "shard_id").select("shard_id", "node_id", F.col("applied").cast("bigint").alias("applied"), (F.col("last") - F.col("applied")).cast("bigint").alias("lag"))


def most_up_to_date(lags: DataFrame) -> DataFrame:
    """The follower to promote on each shard: the furthest one, of equal ones the first by name."""
    best = F.min(F.struct("lag", "node_id"))
    return lags.groupBy("shard_id").agg(best.alias("b")).select("shard_id", "b.node_id", "b.lag")


def next_number(df: DataFrame, column: str, first: int = 0) -> Column:
    return df.agg(F.coalesce(F.max(column) + 1, F.lit(first)).alias("next"))


class Table:
    """Changes in numbered generations of Parquet under a folder, newest generation last.

    A write is a new generation; Spark's commit makes it visible at once or not at all. Compaction writes the newest
    version of every key, deletions included, as one more generation and drops the old ones afterwards; since reading
    takes the newest version anyway, a crash in between changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, compact_after: int = 4):
        self.spark, self.path, self.compact_after = spark, path, compact_after
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._place = hadoop.Path
        self.files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        """Numbers of the complete generations, newest first; anything else in the folder is ignored."""
        root = self._place(self.path)
        if not self.files.exists(root):
            return []
        names = [str(s.getPath().getName()) for s in self.files.listStatus(root)]
        done = [n for n in names if n.startswith("gen=") and n[4:].isdigit() and self.files.exists(self._place(f"{self.path}/{n}/_SUCCESS"))]
        return sorted((int(n[4:]) for n in done), reverse=True)

    def changes(self) -> DataFrame:
        found = self.generations()
        if not found:
            return self.spark.createDataFrame([], CHANGE)
        done = self.compacted_at()  # what it replaces needn't be read
        return self.spark.read.schema(CHANGE).parquet(*[f"{self.path}/gen={g}" for g in found if g >= done])

    def next_seq(self) -> int:
        return int(next_number(self.changes(), "seq", 1).first().next)

    def write(self, cells: DataFrame, order: str | None = None) -> None:
        """Put (key, value) cells over what is there; a null value deletes its key.

        Of repeated keys the one with the largest value of the column `order` wins; without that column the largest value.
        """
        seq = self.next_seq()
        op = F.when(F.col("value").isNull(), "del").otherwise("put")
        if order is not None:
            newest = cells.groupBy("key").agg(F.max(F.struct(F.col(order).alias("o"), "value")).alias("v"))
            cells = newest.select("key", "v.value")
        self._save(cells.select(F.lit(seq).cast("bigint").alias("seq"), op.alias("op"), "key", "value"))
        if sum(g >= self.compacted_at() for g in self.generations()) >= self.compact_after:
            self.compact()

    def restore(self, changes: DataFrame) -> None:
        """Take over changes that carry their own sequence numbers, as from a log that is replayed. Taking one twice changes
        nothing, since the newest version of a key is the same."""
        self._save(checked_ops(changes).select("seq", "op", "key", "value"))

    def _save(self, changes: DataFrame) -> None:
        new = f"{self.path}/_new-{uuid.uuid4().hex}"
        changes.sortWithinPartitions("key").write.parquet(new)
        number = max(self.generations(), default=0) + 1
        if not self.files.rename(self._place(new), self._place(f"{self.path}/gen={number}")):
            raise OSError(f"generation {number} exists already")

    def compact(self) -> None:
        """One generation of the newest versions. Those that it replaces stay until the next compaction, for plans that
        still read them."""
        old = self.generations()
        done = self.compacted_at()
        self._save(latest(self.changes()))
        self.files.mkdirs(self._place(f"{self.path}/_compacted-{self.generations()[0]}"))
        for g in old:
            if g < done:
                self.files.delete(self._place(f"{self.path}/gen={g}"), True)

    def compacted_at(self) -> int:
        """The number of the newest compacted generation, 0 without one."""
        root = self._place(self.path)
        names = [str(s.getPath().getName()) for s in self.files.listStatus(root)] if self.files.exists(root) else []
        return max((int(n[11:]) for n in names if n.startswith("_compacted-")), default=0)

    def snapshot(self) -> DataFrame:
        return snapshot(self.changes())

    def get(self, key: str) -> str | None:
        row = lookup(self.changes(), key).first()
        return row.value if row else None
