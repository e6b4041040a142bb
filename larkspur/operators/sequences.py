"""Ordered histories: training examples, vocabulary, fixed-length encoding, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numbering import numbered

PAD, UNKNOWN = 0, 1
PAD_TOKEN, UNKNOWN_TOKEN = "<PAD>", "<UNK>"


def event_tokens() -> Column:
    """An event as two tokens; a missing item is written None."""
    return F.array(F.concat(F.lit("event:"), F.col("event_type")), F.concat(F.lit("item:"), F.coalesce("item_id", F.lit("None"))))


def histories(events: DataFrame) -> DataFrame:
    """user_id and its events by time, those of equal time by arrival. As long as a user's history is."""
    one = F.struct("timestamp", "pos", "event_type", "item_id")
    return events.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("history"))


def examples(events: DataFrame, max_history: int = 10, positive: str = "purchase") -> DataFrame:
    """For each event but a user's first one: the tokens of up to max_history events before it, and is it positive?

    Columns pos (of the event that is asked about), user_id, user_first (arrival of the user's first event), timestamp, tokens, label,
    target_event_type, target_item_id. Frames are bounded, so a user's history is never held.
    """
    by = Window.partitionBy("user_id").orderBy("timestamp", "pos")
    before = F.flatten(F.collect_list(event_tokens()).over(by.rowsBetween(-max_history, -1)))
    first = F.min("pos").over(Window.partitionBy("user_id"))
    rows = events.select("pos", "user_id", first.alias("user_first"), "timestamp", before.alias("tokens"), (F.col("event_type") == positive).cast("int").alias("label"), F.col("event_type").alias("target_event_type"), F.col("item_id").alias("target_item_id"))
    return rows.where(F.size("tokens") > 0)


def vocabulary(found: DataFrame) -> DataFrame:
    """token, id of all tokens of examples in the order in which they first stand there, from 2; with PAD and UNKNOWN."""
    spread = found.select("user_first", "timestamp", "pos", F.posexplode("tokens").alias("at", "token"))
    first = spread.groupBy("token").agg(F.min(F.struct("user_first", "timestamp", "pos", "at")).alias("first"))
    ids = numbered(first.select("token", "first.*"), ["user_first", "timestamp", "pos", "at"], "n").select("token", (F.col("n") + 1).cast("int").alias("id"))
    special = found.sparkSession.createDataFrame([(PAD_TOKEN, PAD), (UNKNOWN_TOKEN, UNKNOWN)], "token string, id int")
    return special.unionByName(ids)


def encoded(found: DataFrame, vocab: DataFrame, length: int = 20) -> DataFrame:
    """pos and ids: the last `length` tokens as ids, padded on the left."""
    last = F.expr(f"if(size(tokens) > {length}, slice(tokens, -{length}, {length}), tokens)")
    spread = found.select("pos", F.posexplode(last).alias("at", "token")).join(vocab, "token", "left")
    ids = F.array_sort(F.collect_list(F.struct("at", F.coalesce("id", F.lit(UNKNOWN)).alias("id"))))
    packed = spread.groupBy("pos").agg(ids.alias("s")).select("pos", F.col("s.id").alias("own"))
    padding = F.array_repeat(F.lit(PAD), F.greatest(F.lit(0), F.lit(length) - F.coalesce(F.size("own"), F.lit(0))))
    none = F.array().cast("array<int>")
    return found.select("pos").join(packed, "pos", "left").select("pos", F.concat(F.when(F.col("own").isNull(), F.array_repeat(F.lit(PAD), F.lit(length))).otherwise(padding), F.coalesce("own", none)).alias("ids"))


def decoded(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """(..., id) with the token of each id, UNKNOWN_TOKEN for others."""
    return ids.join(vocab, "id", "left").withColumn("token", F.coalesce("token", F.lit(UNKNOWN_TOKEN)))


def stratified_split(found: DataFrame, ratio: float = 0.3) -> DataFrame:
    """Examples with is_test: of each label the first share by user (as text) and time, at least one of several."""
    n = F.col("_of")
    tests = F.when(n > 1, F.greatest(F.lit(1), F.floor(n * F.lit(ratio)))).otherwise(0)
    rows = numbered(found, ["user_id", "timestamp", "pos"], "_at", by=["label"], total="_of")
    return rows.withColumn("is_test", F.col("_at") <= tests).drop("_at", "_of")


def prefix_split(found: DataFrame, ratio: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Train and test parts by order: the first 1 - ratio, the rest. Fewer than three examples are both."""
    n = found.count()
    if n < 3:
        return found, found
    cut = max(1, int(n * (1 - ratio)))
    at = numbered(found, ["user_first", "timestamp", "pos"], "_at")
    return at.where(F.col("_at") <= cut).drop("_at"), at.where(F.col("_at") > cut).drop("_at")


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, id int").parquet(path)
