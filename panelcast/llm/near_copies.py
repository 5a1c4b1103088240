"""One row of each group of near copies, and rows as wholes while operators work on them.

Rows are laid into one column beside doc_id and text, so that operators meet no other name,
whatever columns a table has. They come back as they were given.

Defined cases: rows are known by hashes of doc_id and text, so those with a null or repeated
doc_id are judged one by one; of rows equal in both one stays, the first by a hash of the
other columns; null and empty texts, and those without a word, are copies of nothing and all
stay; texts of any length are compared whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm import jaccard_join
from panelcast.session import materialize

OWN = "own"
#: Keeps ``own`` from being empty.
MARK = "no column of a table"


def plain_text(docs: DataFrame, name: str) -> bool:
    return name == "text" and isinstance(docs.schema[name].dataType, T.StringType)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the row's other columns as ``own``. A text that is a string is there
    once, one of another type in ``own`` as well."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if not plain_text(docs, c)], F.lit(0).alias(MARK)).alias(OWN)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), whole)


def unpacked(rows: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The rows with their own columns; those in ``changed`` have new values."""
    held = rows.schema[OWN].dataType.names
    given = {c: F.col(f"{OWN}.`{c}`") if c in held else F.col("text") for c in columns} | (changed or {})
    return rows.select(*[given[c].alias(c) for c in columns])


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def keep_one(docs: DataFrame, size: int, per_cent: int) -> DataFrame:
    """Of rows connected by links of ``jaccard_join``, the one with the smallest doc_id (null
    comes last, ties in order of a hash). All other rows of ``docs`` stay."""
    keyed = packed(docs).withColumn("key", row_key())
    linked, _ = jaccard_join.similar_documents(keyed.select(F.col("key").alias("doc_id"), "text"), size=size, per_cent=per_cent)
    linked = linked.where("n_shingles > 0").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    # the text is a part of the key
    others = F.xxhash64(F.lit(0), OWN)
    rows = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.min(others).alias("rest"))
    rows = rows.join(linked.distinct(), "key")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    first = rows.groupBy("group").agg(F.min(place).alias("first"), F.count("*").alias("size"))
    first = first.where("size > 1").select("group", F.col("first.key").alias("stays"))
    rows = rows.join(first, "group", "left")
    stays = F.col("stays").isNull() | (F.col("stays") == F.col("key"))
    judged = materialize(rows.where(~stays | (F.col("n") > 1)).select("key", "rest", stays.alias("stays")))
    single = keyed.join(judged, "key", "left_anti").select("text", OWN)
    repeated = keyed.join(judged.where("stays"), "key").where(others == F.col("rest")).dropDuplicates(["key"])
    return unpacked(single.unionAll(repeated.select("text", OWN)), docs.columns)
