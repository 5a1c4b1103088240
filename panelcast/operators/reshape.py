"""Row concatenation, unpivot and transpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def concat_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both tables; columns that one lacks are NULL there."""
    return first.unionByName(second, allowMissingColumns=True)


def wide_to_long(wide: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return wide.unpivot(keys, columns, name, value)


def long_to_wide(long: DataFrame, keys: list[str], name: str, names: list[str], value: str) -> DataFrame:
    """Pivot with a given column list, so that the schema needs no extra job."""
    return long.groupBy(*keys).pivot(name, names).agg(F.first(value))
