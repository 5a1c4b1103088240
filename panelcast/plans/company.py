"""What a reader sees of one company: its statements and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.sources import statements

STATEMENTS = statements.STATEMENTS


def publish_statements(store: DataFrame, sectors: DataFrame, path: str) -> None:
    """Publish the statements of every company in ``store``, taken from its first sector.

    What other companies have published stays.
    """
    statements.publish_statements(statements.first_sector_statements(store, sectors), path)


def publish_company(store: DataFrame, sectors: DataFrame, path: str, company: str) -> None:
    """Publish one company's statements, as a request for it does."""
    publish_statements(store.where(F.col("company") == company), sectors, path)


def company_statements(spark: SparkSession, path: str, company: str) -> dict[str, DataFrame]:
    """The three statements of a company; each read touches its folder only.

    A company that was never published gives empty tables.
    """
    return {s: statements.read_statements(spark, path, company, s) for s in STATEMENTS}


def company_metrics(metrics: DataFrame, company: str) -> DataFrame:
    """The company's own metric row as one row per metric."""
    return statements.transpose_metrics(metrics.where(F.col("company") == company), "company")


def company_page(spark: SparkSession, path: str, metrics: DataFrame, company: str) -> DataFrame:
    """A company's three statements and its metrics as one long table.

    ``part`` is the statement or ``metrics``, whose rows have no period.
    """
    tables = [
        table.select("company", F.lit(name).alias("part"), "label", "period", "value")
        for name, table in company_statements(spark, path, company).items()
    ]
    shown = company_metrics(metrics, company).select(
        "company",
        F.lit("metrics").alias("part"),
        F.col("metric").alias("label"),
        F.lit(None).cast("date").alias("period"),
        "value",
    )
    return reduce(DataFrame.unionByName, [*tables, shown])
