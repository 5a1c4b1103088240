"""A corpus pipeline out of five operators: from ``documents`` to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bpe, decontaminate, language, suffix_dedup
from panelcast.llm.near_copies import keep_one, packed, unpacked
from panelcast.llm.queries import tokenizer_path
from panelcast.session import bounded_batches, delete_path, scratch_path
from panelcast.sources.tables import read_table

#: A document needs a language that makes up this share of it.
MIN_SHARE = 0.5
#: Near copies: words of a shingle, and the Jaccard similarity of the sets.
NEAR_WORDS = 5
NEAR_PER_CENT = 80
#: Documents that a stage hands to Python at once; all stages run in one session.
BATCH_ROWS = 1000


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (so null and empty texts) or without a prevailing
    language; every other row stays as it is."""
    bounded_batches(spark, BATCH_ROWS)
    model = language.train(language.training_rows(docs))
    told = language.identify(packed(docs), model)
    kept = told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SHARE))
    return unpacked(kept, docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows connected by links, the one with the smallest doc_id stays.

    Near copies share four fifths of their runs of five words, unlike in op4. Odd cases
    are those of ``near_copies``.
    """
    bounded_batches(spark, BATCH_ROWS)
    return keep_one(docs, NEAR_WORDS, NEAR_PER_CENT)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out strings of 50 bytes that a document with a smaller id has too.

    Only whole characters go. Documents of which nothing stays have an empty text; null
    texts stay null.
    """
    bounded_batches(spark, BATCH_ROWS)
    cut = suffix_dedup.remove_repeats(packed(docs), characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(text).cast("long")
    return unpacked(cut, docs.columns, changed)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with an item of ``benchmark``; null and empty texts and
    an empty benchmark overlap with nothing."""
    bounded_batches(spark, BATCH_ROWS)
    rows = decontaminate.without_contaminated(packed(docs), read_table(spark, sf_dir, "benchmark"))
    return unpacked(rows, docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids."""
    bounded_batches(spark, BATCH_ROWS)
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("language", keep_identified),
    ("similar", keep_one_of_similar),
    ("repeats", remove_repeats),
    ("benchmark", drop_contaminated),
    ("tokens", to_tokens),
]

#: EM, banding and merging have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's rows written and read again.

    A stage's folder is removed when the next stage has written its own.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        place = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
        if before:
            delete_path(spark, before)
        before = place
    return docs
