"""The generic job: any mapper, any reducer, retries. For what column expressions can't say."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def retried(call: Callable[[], Any], stage: str, retries: int) -> Any:
    """The result of a call that may fail up to `retries` times."""
    failure: Exception | None = None
    for _ in range(retries + 1):
        try:
            return call()
        except Exception as e:  # any user error counts as a failed try
            failure = e
    raise RuntimeError(f"{stage} failed after {retries + 1} tries") from failure


def map_reduce(records: DataFrame, mapper: Callable[[dict], Iterable[tuple]], reducer: Callable[[Any, list], Any], pair: str, result: str, retries: int = 1) -> DataFrame:
    """Map every record (a dict) to (key, value) pairs and reduce each key's values.

    pair and result are the schemas of (key, value) before and after reducing. Mapping and grouping are distributed; a
    key's values meet in one task, as any reducer over a list needs. Use aggregates where they can say the same.
    """
    if retries < 0:
        raise ValueError("retries must not be negative")
    key, value = [p.split()[0] for p in pair.split(",", 1)]
    out_key, out_value = [p.split()[0] for p in result.split(",", 1)]

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [p for r in frame.to_dict("records") for p in retried(lambda r=r: list(mapper(r)), "mapper", retries)]
            yield pd.DataFrame(rows, columns=[key, value])

    def reduced(frame: pd.DataFrame) -> pd.DataFrame:
        k, values = frame[key].iloc[0], frame[value].tolist()
        return pd.DataFrame([(k, retried(lambda: reducer(k, values), "reducer", retries))], columns=[out_key, out_value])

    return records.mapInPandas(mapped, pair).groupBy(key).applyInPandas(reduced, result)
