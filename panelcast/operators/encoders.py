"""Label and one-hot encoders as fit and transform steps on DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelcast.session import materialize

# Codes of a column that are broadcast, and what a code takes beside its value.
BROADCAST_BYTES = 32 << 20
CODE_BYTES = 48


def ordinal_codes(values: DataFrame) -> DataFrame:
    """Number the sorted distinct non-null values of ``(col, value)`` from 0 per ``col``.

    A column ``key``, if there is one, goes before the value in the order. Values are range-partitioned and numbered inside their partition; the
    partition offsets are then added. No task sees all values of a column.
    """
    distinct = values.where(F.col("value").isNotNull()).distinct()
    by = ["key", "value"] if "key" in values.columns else ["value"]
    ordered = materialize(
        distinct.repartitionByRange("col", *by).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy("_part", "col").orderBy(*by)
    sizes = ordered.groupBy("col", "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("col").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "col", "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    numbered = ordered.withColumn("_inside", F.row_number().over(inside) - 1)
    # One row per partition and column: a size fixed by the shuffle settings.
    return numbered.join(F.broadcast(offsets), ["col", "_part"]).select(
        "col", "value", (F.col("_inside") + F.col("_offset")).cast("double").alias("code")
    )


def category(df: DataFrame, name: str) -> Column:
    """(col, key, value): numbers sort by their key, all else by the value."""
    number = isinstance(df.schema[name].dataType, T.NumericType)
    key = F.col(name).cast("double") if number else F.lit(None).cast("double")
    value = F.when(F.isnan(key), None).otherwise(F.col(name).cast("string")) if number else F.col(name).cast("string")
    return F.struct(F.lit(name).alias("col"), key.alias("key"), value.alias("value"))


def fit_label_encoder(df: DataFrame, columns: list[str], preset: DataFrame | None = None) -> DataFrame:
    """The dictionary ``(col, value, code)``; columns in ``preset`` keep their codes.

    The columns are unpivoted so that all of them are numbered in one job. Numbers
    are in order of size, and NaN has no code.
    """
    fixed = {r["col"] for r in preset.select("col").distinct().collect()} if preset is not None else set()
    open_columns = [c for c in columns if c not in fixed]
    frames = [] if preset is None else [preset.select("col", "value", "code")]
    if open_columns:
        pairs = F.array(*[category(df, c) for c in open_columns])
        frames.append(ordinal_codes(df.select(F.inline(pairs))))
    return materialize(reduce(DataFrame.unionByName, frames))


def apply_label_encoder(df: DataFrame, dictionary: DataFrame, columns: list[str]) -> DataFrame:
    """Replace values by codes; values the dictionary lacks become NULL.

    The codes of a column are broadcast while they take less than ``BROADCAST_BYTES``, so a
    category with most of the rows stays where its rows are. Beyond, the join is left to
    Spark, which splits the rows of such a category (skew join).
    """
    order = df.columns
    size = F.sum(F.octet_length("value") + CODE_BYTES)
    sizes = {r["col"]: r["size"] for r in dictionary.groupBy("col").agg(size.alias("size")).collect()}
    for c in columns:
        codes = dictionary.where(F.col("col") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        if sizes.get(c, 0) <= BROADCAST_BYTES:
            codes = F.broadcast(codes)
        df = df.join(codes, df[c].cast("string") == F.col("_value"), "left")
        df = df.drop(c, "_value").withColumnRenamed("_code", c)
    return df.select(*order)


def one_hot_long(df: DataFrame, keys: list[str], dictionary: DataFrame) -> DataFrame:
    """``(*keys, col, code)`` for every cell whose value ``dictionary`` knows.

    This is the sparse form of :func:`one_hot`: one row per entry of 1, for any
    number of categories. ``dictionary`` is that of :func:`fit_label_encoder`.
    """
    columns = [c for c in df.columns if c not in keys]
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(*keys, F.inline(cells))
    return long.join(dictionary, ["col", "value"]).select(*keys, "col", "code")


def one_hot(df: DataFrame, categories: dict[str, list[str]], labels: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """0/1 columns ``{col}_{value}`` in place of each column of ``categories``.

    The categories become the schema, so the caller names them, in their order.
    Unknown values give zeros everywhere; ``labels`` renames values; columns the
    frame lacks are skipped.
    """
    labels = labels or {}
    out = []
    for c in df.columns:
        if c not in categories:
            out.append(F.col(c))
            continue
        names = labels.get(c, {})
        for value in categories[c]:
            hit = F.when(F.col(c) == value, 1).otherwise(0)
            out.append(hit.alias(f"{c}_{names.get(value, value)}"))
    return df.select(*out)
