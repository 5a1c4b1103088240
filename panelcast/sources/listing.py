"""The listing: one row per traded name with its code and market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from panelcast.sources.tables import read_table

# Codes keep their leading zeros, so they are never inferred as numbers.
LISTING_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("market", T.StringType()),
    ]
)


def read_listing_csv(spark: SparkSession, path: str) -> DataFrame:
    """A UTF-8 file with a header row; columns are taken by position."""
    return (
        spark.read.schema(LISTING_SCHEMA)
        .option("header", True)
        .option("enforceSchema", True)
        .option("encoding", "UTF-8")
        .csv(path)
    )


def write_listing_csv(listing: DataFrame, path: str) -> None:
    listing.select("name", "code", "market").write.mode("overwrite").option("header", True).csv(path)


def padded_code(key: Column) -> Column:
    """At least six digits, zero-filled on the left; longer keys stay whole."""
    text = key.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(6)), F.lit("0"))


def customer_listing(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "customer").select(
        F.col("c_name").alias("name"),
        padded_code(F.col("c_custkey")).alias("code"),
        F.col("c_mktsegment").alias("market"),
    )


def supplier_listing(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "supplier").select(
        F.col("s_name").alias("name"),
        padded_code(F.col("s_suppkey")).alias("code"),
        F.lit("SUPPLIER").alias("market"),
    )


def in_markets(listing: DataFrame, markets: list[str]) -> DataFrame:
    return listing.where(F.col("market").isin(markets))


def union_listings(*listings: DataFrame) -> DataFrame:
    first, *rest = listings
    for other in rest:
        first = first.unionByName(other)
    return first


def codes_for_names(listing: DataFrame, names: list[str]) -> DataFrame:
    return listing.where(F.col("name").isin(names))


def names_for_codes(codes: DataFrame, listing: DataFrame) -> DataFrame:
    """One join in place of a lookup per code; one row per distinct name."""
    found = codes.select("code").distinct().join(listing, "code")
    return found.groupBy("name").agg(
        F.min("code").alias("code"), F.min_by("market", "code").alias("market")
    )


def sorted_listing(listing: DataFrame) -> DataFrame:
    return listing.orderBy("name", "code")
