"""A transparent purchase-intent scorer over served features, and an audit of predictions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, prediction_key, sigmoid

# The scorer's weights and bias.
WEIGHTS = {
    "event_count": 0.05, "click_count": 0.08, "purchase_count": 0.75, "total_purchase_amount": 0.015,
    "recent_event_count": 0.06, "recent_click_count": 0.08, "recent_purchase_count": 0.9, "recent_total_purchase_amount": 0.02,
}
BIAS = -2.0


def ladder(confidence: Column, probability: Column, unsure: float, likely: float, maybe: float) -> Column:
    return F.when(confidence < unsure, "uncertain").when(probability >= likely, "likely_to_purchase").when(probability >= maybe, "maybe_interested").otherwise("low_intent")


@dataclass(frozen=True)
class IntentModel:
    version: str = "purchase-intent-v1"
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    bias: float = BIAS

    def predict(self, served: DataFrame) -> DataFrame:
        """Scores of served features. Labels look at unrounded values; a missing feature costs 0.12 of confidence, no recent activity 0.2."""
        score = sum((F.col(f) * w for f, w in self.weights.items()), F.lit(self.bias))
        quiet = ~F.col("recent_activity_available")
        confidence = clamp(F.lit(1.0) - F.size("missing") * 0.12 - F.when((F.col("recent_windows_checked") > 0) & quiet, 0.2).otherwise(0.0), 0.1, 1.0)
        rows = served.withColumn("_base", sigmoid(score)).withColumn("_confidence", confidence)
        rows = rows.withColumn("_p", clamp(F.col("_base") * (F.col("_confidence") * 0.25 + 0.75), 0.0, 1.0))
        warnings = F.concat(F.transform("missing", lambda m: F.concat(F.lit("missing_"), m)), F.when(quiet, F.array(F.lit("no_recent_stream_activity"))).otherwise(F.array().cast("array<string>")))
        return rows.select(
            "user_id", F.lit(self.version).alias("model_version"), F.round("_p", 4).alias("purchase_probability"), F.round("_base", 4).alias("base_probability"), F.round("_confidence", 4).alias("confidence"),
            ladder(F.col("_confidence"), F.col("_p"), 0.5, 0.7, 0.35).alias("label"), warnings.alias("warnings"), "missing",
        )


def audit(predictions: DataFrame) -> DataFrame:
    """prediction_count, average_probability, average_confidence; zeros without predictions."""
    return predictions.agg(F.count("*").alias("prediction_count"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(n) for c, n in (("purchase_probability", "average_probability"), ("confidence", "average_confidence"))])


def label_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label").agg(F.count("*").alias("predictions"))


def prediction_cells(predictions: DataFrame) -> DataFrame:
    """What a prediction writes back: key, value."""
    user = F.col("user_id")
    cells = F.array(F.struct(prediction_key(user, "purchase_probability").alias("key"), F.col("purchase_probability").cast("string").alias("value")), F.struct(prediction_key(user, "label").alias("key"), F.col("label").alias("value")))
    return predictions.select(F.explode(cells).alias("c")).select("c.key", "c.value")


def prediction_lineage(predictions: DataFrame, keys: DataFrame) -> DataFrame:
    """A lineage record of each prediction; keys has user_id, source_keys, recent_source_keys."""
    user = F.col("user_id")
    return predictions.join(keys, "user_id").select(
        F.lit("prediction_lineage").alias("record_type"), "user_id", "model_version", F.concat("source_keys", "recent_source_keys").alias("input_feature_keys"),
        F.array(prediction_key(user, "purchase_probability"), prediction_key(user, "label")).alias("output_keys"), F.col("missing").alias("missing_features"),
        F.create_map(F.lit("label"), F.col("label"), F.lit("confidence"), F.col("confidence").cast("string")).alias("extra"),
    )
