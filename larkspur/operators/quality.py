"""Validation of events: issues of each row, valid rows, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_number, number, trimmed

ALLOWED = ("add_to_cart", "click", "purchase", "view")


def issues(require_timestamp: bool = False, allowed: tuple[str, ...] = ALLOWED, has_amount: bool = True) -> Column:
    """The issues of an event as array<struct<field, message, value>>, in the order of the fields."""

    def issue(field: str, message: str, bad: Column) -> Column:
        return F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"), F.col(field).cast("string").alias("value")))

    def blank(c: str) -> Column:
        return F.col(c).isNull() | (trimmed(F.col(c).cast("string")) == "")

    kind = F.lower(trimmed(F.col("event_type").cast("string")))
    found = [
        issue("user_id", "user_id is required", blank("user_id")), issue("event_type", "event_type is required", blank("event_type")),
        issue("event_type", f"event_type must be one of {sorted(allowed)}", ~blank("event_type") & ~kind.isin(*allowed)),
    ]
    if require_timestamp:
        time = F.col("timestamp").cast("string")
        found += [issue("timestamp", "timestamp is required", time.isNull()), issue("timestamp", "timestamp must be numeric", time.isNotNull() & ~is_number(time))]
    if has_amount:
        amount = F.col("amount").cast("string")
        found += [issue("amount", "amount must be numeric", amount.isNotNull() & ~is_number(amount)), issue("amount", "amount must be non-negative", F.coalesce(number(amount) < 0, F.lit(False)))]
    return F.array_compact(F.array(*found))


def validated(events: DataFrame, require_timestamp: bool = False, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The events with their issues; a row is valid if it has none."""
    return events.withColumn("issues", issues(require_timestamp, allowed, "amount" in events.columns))


def valid_events(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("issues") == 0).drop("issues")


def issue_rows(checked: DataFrame, index: str = "pos") -> DataFrame:
    """One row for each issue: index, field, message, value."""
    return checked.select(F.col(index).alias("index"), F.inline("issues"))


def quality_totals(checked: DataFrame) -> DataFrame:
    """total_count, valid_count, invalid_count, issue_count, ok."""
    totals = checked.agg(F.count("*").alias("total_count"), F.count_if(F.size("issues") == 0).alias("valid_count"), F.count_if(F.size("issues") > 0).alias("invalid_count"), F.coalesce(F.sum(F.size("issues")), F.lit(0)).cast("bigint").alias("issue_count"))
    return totals.withColumn("ok", F.col("issue_count") == 0)


def merged_reports(reports: dict[str, DataFrame]) -> DataFrame:
    """The issue rows of several reports under one another. Indexes are those of each report, so source tells them apart."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in reports.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
