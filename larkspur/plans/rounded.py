"""Features as the registered queries show them: sums rounded to four digits, since engines add in different orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import format_value
from ..operators import features as ft


def user_features(events: DataFrame) -> DataFrame:
    return ft.rounded(ft.user_features(events))


def window_features(events: DataFrame, size: int = 60) -> DataFrame:
    return ft.rounded(ft.window_features(events, size))


def value_text(value: Column) -> Column:
    return format_value(F.round(value.cast("double"), 4))
