"""Window features from a stream of the event log, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import BATCH_FEATURES, format_value
from ..operators.features import aggregates, as_cells, guarded, window_features
from ..operators.quality import issues, valid_events
from ..operators.store import Table
from ..sources.events import EventLog


def flat(log: DataFrame) -> DataFrame:
    """The log's events, with their offset as pos."""
    return log.select("event.*", F.col("offset").alias("pos"))


def stream_features(events: DataFrame, size: int = 60, watermark: str | None = None) -> DataFrame:
    """Streaming window features, for update mode.

    Windows stay open for ever, as late events may always come, so state grows with users and windows. A watermark bounds
    it, and drops what is later than that.
    """
    events = guarded(events, "user_id", "event_type", "timestamp").withColumn("event_time", F.timestamp_seconds("timestamp"))
    if watermark is not None:
        events = events.withWatermark("event_time", watermark)
    out = events.groupBy("user_id", F.window("event_time", f"{size} seconds").alias("w")).agg(*aggregates())
    return out.select("user_id", F.unix_seconds("w.start").alias("window_start"), *BATCH_FEATURES)


def process_available(log: EventLog, store: Table, checkpoint: str, size: int = 60, max_files: int | None = None, quarantine: str | None = None) -> StreamingQuery:
    """Bring a store up to date with all new log records of one consumer group (its checkpoint folder), then stop.

    Each micro-batch adds its window features to those stored, and notes its number under a key of its own in the same
    write; a batch that is replayed after a crash finds its number and writes nothing. Invalid events go to the
    quarantine folder if one is given, else they fail the batch.
    """
    options = {} if max_files is None else {"maxFilesPerTrigger": str(max_files)}
    marker = f"stream:{checkpoint}:batch"

    def apply(batch: DataFrame, number: int) -> None:
        done = store.get(marker)
        if done is not None and int(done) >= number:
            return
        events = flat(batch)
        if quarantine is not None:
            checked = events.withColumn("issues", issues(require_timestamp=True)).persist()
            bad = checked.where(F.size("issues") > 0)  # a replayed batch writes its own folder over
            bad.write.mode("overwrite").json(f"{quarantine}/batch={number}")
            events = valid_events(checked)
        deltas = as_cells(window_features(events, size)).withColumnRenamed("value", "delta")
        new = deltas.join(store.snapshot(), "key", "left").select("key", added(F.col("value"), F.col("delta")).alias("value"))
        note = batch.sparkSession.createDataFrame([(marker, str(number))], "key string, value string")
        store.write(new.unionByName(note))
        if quarantine is not None:
            checked.unpersist()

    writer = log.stream(**options).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.start()
    query.awaitTermination()
    return query


def added(stored: Column, delta: Column) -> Column:
    return format_value(F.coalesce(stored.cast("double"), F.lit(0.0)) + delta.cast("double"))
