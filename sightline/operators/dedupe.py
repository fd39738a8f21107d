"""One row per key out of its versions. Partial aggregation runs before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one(df: DataFrame, keys: list[str], order: str, pick) -> DataFrame:  # noqa: ANN001
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(pick(F.struct(order, *rest)).alias("__r")).select(*keys, *(F.col("__r")[c].alias(c) for c in (order, *rest)))


def latest_version(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that is last in ``order``: the state after upserting all versions."""
    return _one(df, keys, order, F.max)
