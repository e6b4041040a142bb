"""Features of users: over all history, and over tumbling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import BATCH_FEATURES, batch_key, format_value, parse_value, window_key, window_start


def guarded(events: DataFrame, *fields: str) -> DataFrame:
    """The events; a null in one of the fields fails the job."""
    for f in fields:
        bad = F.raise_error(F.lit(f"event is missing {f}")).cast(events.schema[f].dataType)
        events = events.withColumn(f, F.when(F.col(f).isNull(), bad).otherwise(F.col(f)))
    return events


def feature_pairs(events: DataFrame) -> DataFrame:
    """One row (user_id, feature, amount) for each feature that an event adds to. Types are compared as they stand."""
    kind = F.col("event_type")
    pair = lambda name, value: F.struct(F.lit(name).alias("feature"), value.cast("double").alias("amount"))
    added = F.array(
        pair("event_count", F.lit(1)), F.when(kind == "click", pair("click_count", F.lit(1))), F.when(kind == "purchase", pair("purchase_count", F.lit(1))),
        F.when(kind == "purchase", pair("total_purchase_amount", F.coalesce("amount", F.lit(0.0)))),
    )
    kept = [c for c in ("user_id", "window_start", "pos") if c in events.columns]
    return guarded(events, "user_id", "event_type").select(*kept, F.explode(F.array_compact(added)).alias("p")).select(*kept, "p.feature", "p.amount")


def aggregates() -> list[Column]:
    """The four features as one pass of conditional aggregates; a feature to which no event adds is null."""
    kind, some = F.col("event_type"), lambda c: F.when(F.count_if(c) > 0, F.count_if(c))
    amount = F.when(kind == "purchase", F.coalesce("amount", F.lit(0.0)))
    return [F.count("*").alias("event_count"), some(kind == "click").alias("click_count"), some(kind == "purchase").alias("purchase_count"), F.sum(amount).alias("total_purchase_amount")]


def user_features(events: DataFrame) -> DataFrame:
    """user_id and its features over all history."""
    return guarded(events, "user_id", "event_type").groupBy("user_id").agg(*aggregates())


def window_features(events: DataFrame, size: int = 60) -> DataFrame:
    """user_id, window_start and the features of that window; windows never close."""
    events = guarded(events, "user_id", "event_type", "timestamp").withColumn("window_start", window_start(F.col("timestamp"), size))
    return events.groupBy("user_id", "window_start").agg(*aggregates())


def rounded(features: DataFrame, digits: int = 4) -> DataFrame:
    """The features with sums rounded, as for reports: the last digits of a sum depend on the order of its parts."""
    return features.withColumn(BATCH_FEATURES[3], F.round(BATCH_FEATURES[3], digits))


def as_cells(features: DataFrame) -> DataFrame:
    """A wide table as (key, value) text cells; features without a value have no cell."""
    windowed = "window_start" in features.columns
    key = lambda f: window_key(F.col("user_id"), F.col("window_start"), F.lit(f)) if windowed else batch_key(F.col("user_id"), F.lit(f))
    cells = F.array(*[F.when(F.col(f).isNotNull(), F.struct(key(f).alias("key"), format_value(F.col(f)).alias("value"))) for f in BATCH_FEATURES])
    return features.select(F.explode(F.array_compact(cells)).alias("c")).select("c.key", "c.value")


def grouped_values(events: DataFrame) -> DataFrame:
    """What each key gathers before it is reduced: key, values (as text, by arrival)."""
    pairs = feature_pairs(events).withColumn("key", batch_key(F.col("user_id"), F.col("feature")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "amount")))
    return pairs.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: format_value(x.amount)), ",").alias("values"))


def merged_windows(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """Stored window features plus those of a new batch; what neither has stays without a value."""
    keys = ["user_id", "window_start"]
    both = state.select(*keys, *BATCH_FEATURES).unionByName(deltas.select(*keys, *BATCH_FEATURES))
    return both.groupBy(*keys).agg(*[F.sum(f).alias(f) for f in BATCH_FEATURES[:3]], F.sum(BATCH_FEATURES[3]).alias(BATCH_FEATURES[3]))


def served_features(users: DataFrame, batch: DataFrame, windows: DataFrame, starts: list[int]) -> DataFrame:
    """One row for each user asked for: features (absent ones 0), missing names, recent sums and what was checked.

    users has user_id; starts are the windows that count as recent.
    """
    recent = windows.where(F.col("window_start").isin(starts)) if starts else windows.where(F.lit(False))
    sums = recent.groupBy("user_id").agg(
        *[F.sum(F.coalesce(F.col(f), F.lit(0))).cast("double").alias(f"recent_{f}") for f in BATCH_FEATURES[:3]], F.round(F.sum(F.coalesce(F.col(BATCH_FEATURES[3]), F.lit(0.0))), 4).alias(f"recent_{BATCH_FEATURES[3]}"),
        F.count_if(F.col("event_count") > 0).alias("recent_windows_with_activity"),
    )
    joined = users.select("user_id").join(batch, "user_id", "left").join(sums, "user_id", "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in BATCH_FEATURES]))
    active = F.coalesce("recent_windows_with_activity", F.lit(0)).cast("bigint")
    return joined.select(
        "user_id", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in BATCH_FEATURES], *[F.coalesce(f"recent_{f}", F.lit(0.0)).alias(f"recent_{f}") for f in BATCH_FEATURES],
        missing.alias("missing"), (F.size(missing) == 0).alias("batch_features_available"), (active > 0).alias("recent_activity_available"),
        F.lit(len(starts)).cast("bigint").alias("recent_windows_checked"), active.alias("recent_windows_with_activity"),
    )


def served_keys(users: DataFrame, cells: DataFrame, starts: list[int]) -> DataFrame:
    """user_id and the keys that serving reads: all four of history, and those of recent windows that have a cell."""
    history = users.select("user_id", F.array(*[batch_key(F.col("user_id"), F.lit(f)) for f in BATCH_FEATURES]).alias("source_keys"))
    asked = [F.struct(F.lit(k).alias("n"), window_key(F.col("user_id"), F.lit(s), F.lit(f)).alias("key")) for k, (s, f) in enumerate((s, f) for s in starts for f in BATCH_FEATURES)]
    if not asked:
        return history.withColumn("recent_source_keys", F.array().cast("array<string>"))
    wanted = users.select("user_id", F.explode(F.array(*asked)).alias("a")).select("user_id", "a.n", "a.key")
    found = wanted.join(cells.select("key"), "key", "left_semi").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("r"))
    return history.join(found, "user_id", "left").select("user_id", "source_keys", F.coalesce(F.col("r.key"), F.array().cast("array<string>")).alias("recent_source_keys"))


def read_numbers(cells: DataFrame) -> DataFrame:
    return cells.select("key", parse_value(F.col("value")).alias("number"))
