"""Column functions: keys, value text, windows, ring tokens and the small formulas of the scorers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH_FEATURES = ("event_count", "click_count", "purchase_count", "total_purchase_amount")


def batch_key(user: Column, name: Column) -> Column:
    return F.concat(F.lit("feature:user:"), user, F.lit(":"), name)


def window_key(user: Column, start: Column, name: Column) -> Column:
    return F.concat(F.lit("feature:user:"), user, F.lit(":window:"), start.cast("string"), F.lit(":"), name)


def prediction_key(user: Column, name: str) -> Column:
    return F.concat(F.lit("prediction:user:"), user, F.lit(f":{name}"))


def format_value(value: Column) -> Column:
    """A number as the shortest text that reads back as it, without a point when it is whole; null counts as 0.

    Exponents are written out as far as 38 digits hold them.
    """

    def plain(text: Column) -> Column:
        return F.when(~text.contains("E"), text).otherwise(F.coalesce(text.try_cast("decimal(38,18)").cast("string"), text))

    shown = plain(F.coalesce(value.cast("double"), F.lit(0.0)).cast("string"))
    return F.when(shown.contains(".") & ~shown.contains("E"), F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)


def parse_value(text: Column) -> Column:
    """A stored number; null stays null, as an absent key does."""
    return text.cast("double")


_DIGITS = "[0-9](?:_?[0-9])*"
#: Decimal numerals with an optional exponent, digits grouped by single underscores, and the names of the other values.
NUMERAL = rf"^\s*[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf(?:inity)?|nan))\s*$"


def is_number(text: Column) -> Column:
    """Is it a numeral? Suffixes (1d, 1f) and hexadecimal ones aren't."""
    return F.coalesce(text.rlike(NUMERAL), F.lit(False))


def number(text: Column) -> Column:
    """The value of a numeral; null for anything else."""
    return F.when(is_number(text), F.regexp_replace(F.trim(text), "_", "").try_cast("double"))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_event_type(text: Column) -> Column:
    """Canonical event types: trimmed, lower case, with two shop synonyms resolved."""
    low = F.lower(trimmed(text))
    return F.when(low == "addtocart", "add_to_cart").when(low == "transaction", "purchase").otherwise(low)


def window_start(timestamp: Column, size: int = 60) -> Column:
    """Begin of the tumbling window of a time in epoch seconds; fractions are cut, negative times are an error."""
    if size <= 0:
        raise ValueError("window size must be positive")
    whole = timestamp.cast("bigint")
    start = whole - whole % size
    return F.when(whole < 0, F.raise_error(F.lit("timestamp must not be negative")).cast("bigint")).otherwise(start)


def window_end(timestamp: Column, size: int = 60) -> Column:
    return window_start(timestamp, size) + size


def ring_token(key: Column) -> Column:
    """A key's place on the ring. Fixed-width hexadecimal text sorts as the 128-bit number does."""
    return F.md5(key)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def safe_logit(p: Column) -> Column:
    p = clamp(p, 0.01, 0.99)
    return F.log(p / (F.lit(1.0) - p))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once; a column used inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(scores: Column) -> Column:
    """Of an array, shifted by its maximum."""
    shares = lambda raised: let(F.aggregate(raised, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(raised, lambda x: x / total))
    return let(scores, lambda v: let(F.array_max(v), lambda top: let(F.transform(v, lambda s: F.exp(s - top)), shares)))
