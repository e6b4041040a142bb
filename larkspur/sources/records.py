"""Append-only record tables: predictions, lineage, experiments, quality reports, models and vocabularies."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINEAGE = "timestamp string, record_type string, user_id string, model_version string, input_feature_keys array<string>, output_keys array<string>, missing_features array<string>, extra map<string, string>"
EXPERIMENT = "timestamp string, experiment string, metric string, value double, unit string, parameters map<string, string>"


def stamped(df: DataFrame) -> DataFrame:
    """With the present time in UTC as ISO 8601 text in front."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return df.select(now.alias("timestamp"), *[c for c in df.columns if c != "timestamp"])


class Records:
    """A folder of JSON lines that is only appended to."""

    def __init__(self, spark: SparkSession, path: str, schema: str | None = None):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, df: DataFrame) -> None:
        stamped(df).write.mode("append").json(self.path)

    def read(self) -> DataFrame:
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.json(self.path)


def experiment(spark: SparkSession, name: str, metric: str, value: float, unit: str, parameters: dict[str, Any] | None = None) -> DataFrame:
    text = {k: str(v) for k, v in (parameters or {}).items()}
    return spark.createDataFrame([(name, metric, float(value), unit, text)], "experiment string, metric string, value double, unit string, parameters map<string, string>")


def write_report(report: DataFrame, path: str) -> None:
    """Overwrite a report of one row."""
    report.coalesce(1).write.mode("overwrite").json(path)


def unpivoted(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row for each metric of a wide table: keys, metric, value."""
    return metrics.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(*keys, "m.metric", "m.value")


def log_event(logger: logging.Logger, message: str, **fields: Any) -> None:
    """A structured line on the driver's log."""
    logger.info(json.dumps({"message": message, **fields}, sort_keys=True, default=str))


def get_logger(name: str) -> logging.Logger:
    logger = logging.getLogger(name)
    if not logger.handlers:
        logger.addHandler(logging.StreamHandler())
        logger.setLevel(logging.INFO)
    return logger


def timed(label: str, action: Callable[[], Any]) -> dict[str, Any]:
    """What an action returns, and its seconds on the driver."""
    began = time.perf_counter()
    result = action()
    return {"label": label, "seconds": time.perf_counter() - began, "result": result}
