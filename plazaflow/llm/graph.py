"""What reaches what: connected components, and the least value of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazaflow.llm.common import cut
from plazaflow.operators.graph import components  # noqa: F401


def least_of(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with the least `value` of each row's key (nulls count only where there is nothing else). The least ones are
    written before they are joined, so that a key with very many rows splits like any skewed join."""
    least = cut(df.groupBy(key).agg(F.min(value).alias(name)))
    return df.join(least, key)
