"""Queries that run as streams, over copies of the event table as a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Table
from ..sources.events import EventLog, table_events
from ..sources.shared import new_folder
from ..streaming.processor import process_available, stream_features
from ..operators.features import rounded
from . import sql
from .registry import query
from .rounded import value_text


def _logged(spark: SparkSession, d: str, parts: int = 3) -> tuple[EventLog, str]:
    """The events as a log of several appends."""
    folder = new_folder(spark, "stream")
    log = EventLog(spark, f"{folder}/log")
    records = table_events(spark, d).select(F.col("pos").alias("offset"), F.struct("user_id", "event_type", "amount", "timestamp").alias("event"))
    for k in range(parts):
        records.where(F.col("offset") % parts == k).write.mode("append").json(log.path)
    return log, folder


@query(f"WITH {sql.EV}, {sql.windows(60)} SELECT * FROM win")
def stream_window_features(spark: SparkSession, d: str) -> DataFrame:
    """Update mode: what a window's features are after the last micro-batch that touched it."""
    log, folder = _logged(spark, d)
    events = log.stream(maxFilesPerTrigger="1").select("event.*")
    out = f"{folder}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    stream_features(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(out)
    columns = [c for c in updates.columns if c not in ("user_id", "window_start", "batch")]
    last = updates.groupBy("user_id", "window_start").agg(F.max_by(F.struct(*columns), "batch").alias("f"))
    return rounded(last.select("user_id", "window_start", *[F.col(f"f.{c}").alias(c) for c in columns]))


@query(f"WITH {sql.EV}, {sql.windows(60)} {sql.WINDOW_CELLS}")
def stream_store_features(spark: SparkSession, d: str) -> DataFrame:
    """Micro-batches added to a store, which then holds what one batch over all events gives."""
    log, folder = _logged(spark, d)
    store = Table(spark, f"{folder}/store")
    process_available(log, store, f"{folder}/checkpoint", max_files=4)
    return store.snapshot().where(~F.col("key").startswith("stream:")).select("key", value_text(F.col("value")).alias("value"))
