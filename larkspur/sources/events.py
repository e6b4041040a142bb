"""Event sources: schemas, the event table, CSV files, a built-in sample, generators and the append-only log."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import normalize_event_type
from ..operators.numbering import numbered

EVENT = "user_id string, event_type string, amount double, timestamp bigint, item_id string, pos bigint"
LOG = "offset bigint, event struct<user_id: string, event_type: string, amount: double, timestamp: bigint>"


def table_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as engine events; pos (the event_id) stands for arrival order."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("string").alias("user_id"), "event_type", F.col("value").alias("amount"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.get_json_object("props", "$.k").alias("item_id"), F.col("event_id").alias("pos"),
    )


def shop_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """A shop log with the header timestamp,visitorid,event,itemid; ids as text, types canonical, times cut to integers."""
    raw = spark.read.option("header", True).schema("timestamp string, visitorid string, event string, itemid string").csv(path)
    raw = raw.limit(max_rows) if max_rows is not None else raw
    return raw.select(
        F.col("visitorid").alias("user_id"), normalize_event_type(F.col("event")).alias("event_type"), F.lit(None).cast("double").alias("amount"),
        F.col("timestamp").cast("double").cast("bigint").alias("timestamp"), F.col("itemid").alias("item_id"), F.monotonically_increasing_id().alias("pos"),
    )


# A small shop history, as user: events of (type, item, time).
SAMPLE = {
    "0": [("view", "laptop", 1), ("view", "laptop", 2), ("add_to_cart", "laptop", 3), ("view", "mouse", 4), ("purchase", "laptop", 5)],
    "1": [("view", "phone", 1), ("view", "case", 2), ("add_to_cart", "phone", 3), ("purchase", "phone", 6)],
    "2": [("view", "keyboard", 1), ("view", "monitor", 2), ("view", "monitor", 3)],
    "3": [("view", "camera", 1), ("add_to_cart", "camera", 2), ("view", "lens", 3), ("purchase", "camera", 4)],
    "4": [("view", "book", 1), ("view", "book", 2), ("view", "pen", 3)],
    "5": [("view", "tablet", 1), ("add_to_cart", "tablet", 2), ("view", "tablet", 3), ("purchase", "tablet", 5)],
    "6": [("view", "chair", 1), ("view", "desk", 2)],
    "7": [("view", "headphones", 1), ("add_to_cart", "headphones", 3)],
    "8": [("view", "speaker", 1), ("view", "speaker", 2), ("add_to_cart", "speaker", 4), ("purchase", "speaker", 6)],
}


def sample_events(spark: SparkSession) -> DataFrame:
    flat = [(user, kind, None, time, item) for user, events in SAMPLE.items() for kind, item, time in events]
    return spark.createDataFrame([(*row, pos) for pos, row in enumerate(flat)], EVENT)


def file_or_sample(spark: SparkSession, path: str, max_rows: int | None = None) -> tuple[DataFrame, str]:
    """Events of a CSV file if Spark finds it, else the sample; and which it was."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return shop_csv(spark, path, max_rows), path
    return sample_events(spark), "sample"


def made_batch_events(spark: SparkSession, count: int) -> DataFrame:
    """Every fifth event is a purchase of 10, the others are clicks; users repeat every max(25, count / 20) events."""
    buys = F.col("id") % 5 == 0
    return _made(spark, count, F.col("id") % max(25, count // 20), buys, 10.0)


def made_stream_events(spark: SparkSession, count: int) -> DataFrame:
    """Every seventh event is a purchase of 5; the time is the event's number."""
    buys = F.col("id") % 7 == 0
    return _made(spark, count, F.col("id") % max(25, count // 20), buys, 5.0)


def made_clicks(spark: SparkSession, count: int, hot: bool = False) -> DataFrame:
    """Clicks of 100 users in turn; hot: of every ten events the first eight are one user's."""
    user = (F.col("id") % 100).cast("string")
    if hot:
        user = F.when(F.col("id") % 10 < 8, "hot-user").otherwise(user)
    return _made(spark, count, user, F.lit(False), 0.0)


def _made(spark: SparkSession, count: int, user, buys, amount: float) -> DataFrame:
    return spark.range(count).select(
        user.cast("string").alias("user_id"), F.when(buys, "purchase").otherwise("click").alias("event_type"), F.when(buys, F.lit(amount)).alias("amount"),
        F.col("id").alias("timestamp"), F.lit(None).cast("string").alias("item_id"), F.col("id").alias("pos"),
    )


class EventLog:
    """An append-only log of JSON lines: rows (offset, event). Each append is a file of its own in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def next_offset(self) -> int:
        return int(self.read().agg(F.coalesce(F.max("offset") + 1, F.lit(0)).alias("n")).first().n)

    def append(self, events: DataFrame) -> int:
        """Append events in the order of pos; the first offset that they got. One writer at a time."""
        first = self.next_offset()
        own = F.struct(*[F.col(c) for c in ("user_id", "event_type", "amount", "timestamp")]).alias("event")
        at = (F.col("_n") - 1 + first).alias("offset")
        numbered(events, ["pos"], "_n").select(at, own).write.mode("append").json(self.path)
        return first

    def read(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(self.path)

    def read_from(self, offset: int, max_records: int | None = None) -> DataFrame:
        return log_range(self.read(), offset, max_records)

    def stream(self, **options: str) -> DataFrame:
        return self.spark.readStream.options(**options).schema(LOG).json(self.path)


def log_range(log: DataFrame, offset: int, max_records: int | None = None) -> DataFrame:
    """Records from an offset on, in order; at most max_records of them."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    out = log.where(F.col("offset") >= offset).orderBy("offset")
    return out if max_records is None else out.limit(max_records)


class Offsets:
    """The next offset of each consumer group, as a JSON map in one small driver-side file; 0 for an unknown group."""

    def __init__(self, path: str):
        self.path = Path(path)

    def _all(self) -> dict[str, int]:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def get(self, group: str) -> int:
        return self._all().get(group, 0)

    def commit(self, group: str, offset: int) -> None:
        if offset < 0:
            raise ValueError("offset must not be negative")
        self.path.parent.mkdir(parents=True, exist_ok=True)
        new = self.path.with_suffix(".new")
        new.write_text(json.dumps(self._all() | {group: offset}, sort_keys=True))
        new.replace(self.path)
