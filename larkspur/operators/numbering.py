"""Consecutive numbers in an order, without one task that sorts all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows looked at for each bucket to place its bounds, and the most buckets.
EACH, MOST = 100, 1024


def _bounds(df: DataFrame, names: list[str]) -> list[tuple]:
    """Keys that part the rows into buckets of about equal size, from a sample of a bounded number of keys."""
    buckets = min(MOST, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(*names).orderBy(F.xxhash64(*names)).limit(EACH * buckets)
    return [tuple(r) for r in dict.fromkeys(keys.orderBy(*names).collect()[EACH::EACH])]


def _bucket(key: Column, bounds: list[Column], low: int, high: int) -> Column:
    """The number of bounds at or below the key, found by halving."""
    if low == high:
        return F.lit(low)
    mid = (low + high + 1) // 2
    return F.when(key >= bounds[mid - 1], _bucket(key, bounds, mid, high)).otherwise(_bucket(key, bounds, low, mid - 1))


def numbered(df: DataFrame, order: Sequence[str], column: str, by: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """df with a column that counts from 1 in the given order, anew in each group `by`; total: a column with the group's rows.

    Rows are parted by bounds in that order. A bucket's rows are numbered by themselves and the counts of the buckets
    before are added. The bounds come from a sample, but they only balance the work: numbers are exact whatever they are. Groups
    should be few, as the counts (one row for each bucket and group) are broadcast. Rows that are equal in the order get
    numbers in any order, so it should end in a unique column. Names that begin with _numbering_ are its own.
    """
    own = Window.partitionBy(*by)
    names = [*by, *order]
    bounds = _bounds(df, names)
    if not bounds:  # few rows
        out = df.withColumn(column, F.row_number().over(own.orderBy(*order)).cast("bigint"))
        return out if total is None else out.withColumn(total, F.count("*").over(own))
    kinds = [df.schema[n].dataType for n in names]
    as_key = lambda values: F.struct(*[v.alias(f"k{i}") for i, v in enumerate(values)])
    limits = [as_key([F.lit(v).cast(k) for v, k in zip(b, kinds, strict=True)]) for b in bounds]
    placed = df.withColumn("_numbering_bucket", _bucket(as_key([F.col(n) for n in names]), limits, 0, len(limits)))
    keys = [F.col(b).alias(f"_numbering_by{i}") for i, b in enumerate(by)]
    groups = [f"_numbering_by{i}" for i in range(len(by))]
    counts = placed.groupBy(*keys, F.col("_numbering_bucket").alias("_numbering_at")).agg(F.count("*").alias("_numbering_rows"))
    all_of = Window.partitionBy(*groups)
    before = F.sum("_numbering_rows").over(all_of.orderBy("_numbering_at")) - F.col("_numbering_rows")
    offsets = F.broadcast(counts.select(*groups, "_numbering_at", before.alias("_numbering_before"), F.sum("_numbering_rows").over(all_of).alias("_numbering_total")))
    same = F.col("_numbering_bucket") == F.col("_numbering_at")
    for b, g in zip(by, groups, strict=True):
        same &= F.col(b).eqNullSafe(F.col(g))
    inside = F.row_number().over(Window.partitionBy(*by, "_numbering_bucket").orderBy(*order))
    out = placed.withColumn("_numbering_inside", inside).join(offsets, same).withColumn(column, (F.col("_numbering_before") + F.col("_numbering_inside")).cast("bigint"))
    if total is not None:
        out = out.withColumn(total, F.col("_numbering_total"))
    return out.drop("_numbering_bucket", "_numbering_at", "_numbering_rows", "_numbering_before", "_numbering_total", "_numbering_inside", *groups)
