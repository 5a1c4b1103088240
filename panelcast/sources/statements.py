"""Company statements: the long store, its copy in folders, the nested form, and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelcast.session import materialize, path_exists
from panelcast.sources.market import PRICE
from panelcast.sources.tables import read_table

STATEMENT_KEYS = ["sector", "company", "statement", "label"]

# Names of a company's metrics, in page order (fixed values).
METRICS = [
    "yoy_avg_revenue", "yoy_avg_operating_income", "yoy_avg_ebitda", "yoy_avg_eps", "quick_ratio",
    "receivable_turnover_ratio", "asset_turnover_ratio", "debt_to_equity_ratio", "icr", "revenue",
    "operating_income", "operating_margin", "ebitda", "ebitda_margin", "roe", "cfo_to_earnings", "per",
    "shareholder_return",
]


def _placed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the nation and region of their customer as company and sector."""
    orders = read_table(spark, folder, "orders")
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    places = (
        read_table(spark, folder, "nation")
        .join(read_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.col("n_name").alias("company"), F.col("r_name").alias("sector"))
    )
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        places, F.col("c_nationkey") == F.col("n_nationkey")
    )


def _earned():
    """What a line brings in after its discount."""
    price, discount = F.col("l_extendedprice").cast(PRICE), F.col("l_discount").cast("decimal(5,2)")
    return price * (F.lit(1).cast("decimal(1,0)") - discount)


def _year_end(day: str):
    return F.make_date(F.year(day), F.lit(12), F.lit(31)).alias("period")


def _cash_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with their company: goods that came back count against what was shipped."""
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate", _earned().alias("earned"))
    orders = _placed_orders(spark, folder).select("o_orderkey", "sector", "company")
    returned = F.col("l_returnflag") == "R"
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "sector",
        "company",
        F.when(returned, "returned").otherwise("shipped").alias("label"),
        "l_shipdate",
        F.when(returned, -F.col("earned")).otherwise(F.col("earned")).alias("cash"),
    )


def order_statements(spark: SparkSession, folder: str) -> DataFrame:
    """The three yearly statements: region is the sector, nation the company.

    Income (``cis``): order value by priority. Balance (``bs``): order value by status, what
    is open or settled of the year's orders. Cash flow (``cf``): discounted value of the
    lines shipped, and of those that were returned, as a negative number.
    """
    placed = _placed_orders(spark, folder)
    value = F.sum(F.col("o_totalprice").cast(PRICE)).cast("double").alias("value")
    keys = ["sector", "company"]

    def by(statement: str, label) -> DataFrame:
        return placed.groupBy(*keys, F.lit(statement).alias("statement"), label.alias("label"), _year_end("o_orderdate")).agg(value)

    cash = _cash_lines(spark, folder).groupBy(*keys, F.lit("cf").alias("statement"), "label", _year_end("l_shipdate"))
    return (
        by("cis", F.col("o_orderpriority"))
        .unionByName(by("bs", F.concat(F.lit("orders "), F.col("o_orderstatus"))))
        .unionByName(cash.agg(F.sum("cash").cast("double").alias("value")))
    )


def part_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly sales by part type and brand: a brand occurs in several sectors."""
    lineitem = read_table(spark, folder, "lineitem")
    part = read_table(spark, folder, "part").select("p_partkey", "p_type", "p_brand")
    return (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            F.col("p_type").alias("sector"),
            F.col("p_brand").alias("company"),
            F.when(F.col("l_returnflag") == "R", "bs").otherwise("cis").alias("statement"),
            F.col("l_linestatus").alias("label"),
            F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(31)).alias("period"),
        )
        .agg(F.sum(F.col("l_extendedprice").cast(PRICE)).cast("double").alias("value"))
    )


#: Folders of a store; a company's rows are in the one its name hashes to.
BUCKETS = 64


def _bucketed(statements: DataFrame, buckets: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64("company"), F.lit(buckets)).cast("int")
    return statements.withColumns({"buckets": F.lit(buckets), "bucket": bucket})


def write_statements(statements: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store all companies anew, in ``buckets`` folders and a file for each, so that a million
    companies make no million files and a lookup reads one folder."""
    stored = _bucketed(statements, buckets).repartition("bucket").sortWithinPartitions("bucket", "company", "statement")
    stored.write.mode("overwrite").partitionBy("buckets", "bucket").parquet(path)


def publish_statements(statements: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace the rows of the companies in ``statements`` and of no other.

    Only the folders that these companies hash to are written: their other companies'
    rows are kept beside the new ones, run once and stored, then the folders are
    overwritten one by one. The first publication makes the store.
    """
    spark = statements.sparkSession
    if not path_exists(spark, path):
        write_statements(statements, path, buckets)
        return
    stored = spark.read.parquet(path)
    buckets = stored.select("buckets").first()[0]
    new = materialize(_bucketed(statements, buckets))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    others = stored.where(F.col("bucket").isin(touched)).join(new.select("company").distinct(), "company", "left_anti")
    rows = materialize(others.select(*new.columns).unionByName(new))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "company", "statement")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("buckets", "bucket").parquet(path)


def read_statements(
    spark: SparkSession, path: str, company: str | None = None, statement: str | None = None
) -> DataFrame:
    """Stored statements; those of one company are looked for in its folder only."""
    stored = spark.read.parquet(path)
    if company is not None:
        folder = F.pmod(F.xxhash64(F.lit(company)), F.col("buckets"))
        stored = stored.where((F.col("bucket") == folder) & (F.col("company") == company))
    if statement is not None:
        stored = stored.where(F.col("statement") == statement)
    return stored.drop("buckets", "bucket")


# --- the nested store -----------------------------------------------------------

STATEMENTS = ["cis", "bs", "cf"]
_TABLE = "array<struct<label: string, period: date, value: double>>"
#: sector -> company -> its three statements and its metrics
NESTED = (
    "map<string, map<string, struct<"
    + ", ".join(f"{s}: {_TABLE}" for s in STATEMENTS)
    + ", metrics: map<string, double>>>>"
)


def nest_statements(statements: DataFrame, sectors: DataFrame, metrics: DataFrame | None = None, parts: int = BUCKETS) -> DataFrame:
    """``(sector_ord, store)``: statements as maps of maps, a row for some companies of a sector.

    ``sectors`` gives (sector, sector_ord), ``metrics`` (company, metric, value). A sector's
    companies are dealt to ``parts`` rows by their names, so that no row holds a whole sector.
    """
    entry = F.struct("label", "period", "value")
    tables = [
        F.array_sort(F.collect_list(F.when(F.col("statement") == s, entry))).alias(s) for s in STATEMENTS
    ]
    each = statements.groupBy("sector", "company").agg(*tables)
    if metrics is None:
        each = each.withColumn("metrics", F.lit(None).cast("map<string, double>"))
    else:
        own = metrics.groupBy("company").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
        each = each.join(own, "company", "left")
    part = F.pmod(F.xxhash64("company"), F.lit(parts))
    companies = F.map_from_entries(F.collect_list(F.struct("company", F.struct(*STATEMENTS, "metrics"))))
    rows = each.groupBy("sector", part.alias("part")).agg(companies.alias("companies")).join(sectors, "sector")
    return rows.select("sector_ord", F.create_map("sector", "companies").cast(NESTED).alias("store"))


def unnest_statements(nested: DataFrame) -> DataFrame:
    """The long form of a nested store: one row per sector, company, statement, label and period."""
    by_sector = nested.select("sector_ord", F.explode("store").alias("sector", "companies"))
    by_company = by_sector.select("sector_ord", "sector", F.explode("companies").alias("company", "tables"))
    parts = F.array(*[F.struct(F.lit(s).alias("statement"), F.col(f"tables.{s}").alias("rows")) for s in STATEMENTS])
    spread = by_company.select("sector_ord", "sector", "company", F.inline(parts))
    return spread.select("sector_ord", "sector", "company", "statement", F.inline("rows"))


def unnest_metrics(nested: DataFrame) -> DataFrame:
    """The metrics of a nested store, one row per sector, company and metric."""
    by_sector = nested.select("sector_ord", F.explode("store").alias("sector", "companies"))
    by_company = by_sector.select("sector_ord", "sector", F.explode("companies").alias("company", "tables"))
    return by_company.select("sector_ord", "sector", "company", F.explode("tables.metrics").alias("metric", "value"))


def company_of_nested(nested: DataFrame, company: str) -> DataFrame:
    """The statements of one company, from the first sector whose map has its name.

    Only the maps are asked; the tables of others are not unfolded. A company that is
    nowhere gives no rows.
    """
    has = F.filter(F.map_keys("store"), lambda s: F.map_contains_key(F.element_at("store", s), company))
    held = nested.select("sector_ord", F.explode(has).alias("sector"), "store")
    held = held.select("sector_ord", "sector", F.element_at(F.element_at("store", F.col("sector")), company).alias("tables"))
    first = held.orderBy("sector_ord", "sector").limit(1)
    parts = F.array(*[F.struct(F.lit(s).alias("statement"), F.col(f"tables.{s}").alias("rows")) for s in STATEMENTS])
    spread = first.select("sector", F.lit(company).alias("company"), F.inline(parts))
    return spread.select("sector", "company", "statement", F.inline("rows"))


def first_sector_statements(statements: DataFrame, sectors: DataFrame) -> DataFrame:
    """Each company's statements from the first sector that has the company.

    ``sectors`` gives ``(sector, sector_ord)``. A company without statements
    gives no rows.
    """
    placed = statements.join(sectors, "sector")
    first = placed.groupBy("company").agg(F.min("sector_ord").alias("sector_ord"))
    return placed.join(first, ["company", "sector_ord"]).select(*statements.columns)


def wide_statements(statements: DataFrame, periods: list[str] | None = None) -> DataFrame:
    """One column per year end, newest first, as ``yyyyMMdd``.

    The year ends become the schema; without ``periods`` they are looked up,
    which brings one value per year to the driver.
    """
    named = statements.withColumn("period", F.date_format("period", "yyyyMMdd"))
    if periods is None:
        periods = [r[0] for r in named.select("period").distinct().orderBy(F.desc("period")).collect()]
    return named.groupBy(*STATEMENT_KEYS).pivot("period", periods).agg(F.first("value"))


def long_statements(wide: DataFrame) -> DataFrame:
    """Back to one row per label and year end; empty cells stay, as NULL."""
    periods = [c for c in wide.columns if c not in STATEMENT_KEYS]
    long = wide.unpivot(STATEMENT_KEYS, periods, "period", "value")
    return long.withColumn("period", F.to_date("period", "yyyyMMdd"))


def transpose_metrics(metrics: DataFrame, key: str) -> DataFrame:
    """One row per company and metric from one row per company; NULLs stay."""
    values = [c for c in metrics.columns if c != key]
    return metrics.unpivot([key], values, "metric", "value")


def order_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The row of metrics per company from its yearly orders; those without a source are NULL.

    Revenue is the order value, operating income the discounted value of the orders'
    lines. Growth is the mean over the years, NULL for a single year. Of the last year
    with orders: the quick ratio is settled over other order value, receivables turn over
    by revenue over open order value, and cash flow is what was shipped less returns.
    """
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("company"))
    owner = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "company")
    orders = read_table(spark, folder, "orders").join(owner, F.col("o_custkey") == F.col("c_custkey"))
    placed = orders.select(
        "o_orderkey", "company", "o_orderstatus", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast(PRICE).alias("price")
    )
    earned = read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum(_earned()).alias("income"))

    def paid(status: str):
        return F.sum(F.when(F.col("o_orderstatus") == status, F.col("price"))).cast("double")

    cash = _cash_lines(spark, folder).groupBy("company", F.year("l_shipdate").alias("year"))
    yearly = (
        placed.join(earned, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("company", "year")
        .agg(
            F.sum("price").cast("double").alias("revenue"),
            F.sum("income").cast("double").alias("operating_income"),
            paid("O").alias("open"),
            paid("F").alias("settled"),
        )
        .join(cash.agg(F.sum("cash").cast("double").alias("cash")), ["company", "year"], "left")
    )
    by_year = Window.partitionBy("company").orderBy("year")

    def growth(name: str):
        return F.try_divide(F.col(name), F.lag(name).over(by_year)) - 1

    def last(name: str):
        return F.max_by(name, "year")

    grown = yearly.withColumns({f"{name}_growth": growth(name) for name in ("revenue", "operating_income")})
    known = grown.groupBy("company").agg(
        F.avg("revenue_growth").alias("yoy_avg_revenue"),
        F.avg("operating_income_growth").alias("yoy_avg_operating_income"),
        F.try_divide(last("settled"), last("revenue") - last("settled")).alias("quick_ratio"),
        F.try_divide(last("revenue"), last("open")).alias("receivable_turnover_ratio"),
        last("revenue").alias("revenue"),
        last("operating_income").alias("operating_income"),
        F.try_divide(last("operating_income"), last("revenue")).alias("operating_margin"),
        F.try_divide(last("cash"), last("operating_income")).alias("cfo_to_earnings"),
    )
    return known.select("company", *[F.col(m) if m in known.columns else F.lit(None).cast("double").alias(m) for m in METRICS])
