"""Ranked lexical search of a query set over whole documents, without an index of them.

The distinct terms of all items form one Aho-Corasick automaton. Each term stands in it
between two blanks, and a document is scanned with every character outside a term turned
into a blank, so the automaton meets whole terms only. Its outputs are term numbers, and a
table leads from a term to the items that hold it. One scan of the documents counts how many
of them hold each term (and their sizes), which gives the weights; a second one scores every
document for every item and keeps each task's best per item.

A task sends at most ``limit`` rows per item. These are ranked in two steps, by (item, slot)
and then by item, so that one item's rows are never all in one group. Documents are not
shuffled, and no list of their terms is kept.

The automaton is broadcast. Its size is bounded: items are dealt to blocks by a hash until
the texts of a block have at most ``BLOCK_BYTES`` bytes (or are one item), and every block is
searched by scans of its own. Term frequencies, document frequencies and lengths cover all rows.

Scores are 64-bit integers; only a term's weight is computed in doubles.

Defined cases: a null or empty text has no terms, is found by no item and does not count as
a document; an item without terms has no rows; repeated rows are documents (or items) of their
own; a null doc_id comes after all others among equal scores; texts of any length are scanned
whole; empty tables give an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.textbytes import ALNUM, LOWER, text_slices
from panelcast.session import materialize

LIMIT = 10
#: Bytes of item texts whose terms make one automaton, and what an item counts besides.
BLOCK_BYTES = 2 << 20
ITEM_BYTES = 64
#: Groups among which an item's candidates are dealt before the last ranking.
SLOTS = 64
#: Documents scored at once by a task.
BATCH = 64

#: Bytes of terms, lower-cased (A-Z); all others become blanks.
GUARDED = bytes(np.where(ALNUM[LOWER], LOWER, ord(" ")).astype(np.uint8))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(GUARDED).split()


def lexicon(items: list[tuple[str, str | None]]) -> tuple[ahocorasick.Automaton, np.ndarray, np.ndarray, list[str]]:
    """The automaton of all terms of the items, with their numbers as outputs; the items
    of each term t, as held[first[t]:first[t + 1]]; and the items' keys."""
    own = [sorted(set(terms_of(text))) for _, text in items]
    automaton, number = ahocorasick.Automaton(), {}
    for term in sorted(set().union(*own)):
        number[term] = len(number)
        automaton.add_word(f" {term.decode('latin-1')} ", number[term])
    if number:
        automaton.make_automaton()
    pairs = sorted((number[term], i) for i, held in enumerate(own) for term in held)
    first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(number) + 1))
    return automaton, first, np.array([i for _, i in pairs], np.int64), [key for key, _ in items]


def scanned(batches: Iterator[pa.RecordBatch], automaton: ahocorasick.Automaton):
    """(batch, row, number of terms, frequencies by term) of every document with a term."""
    for batch in batches:
        for first, _, data, offsets in text_slices(batch.column("text")):
            inside = ALNUM[LOWER[data]]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            heads = offsets[:-1][offsets[:-1] < len(data)]
            begins[heads] = inside[heads]
            size = np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets])
            raw = data.tobytes().translate(GUARDED)
            for row in np.flatnonzero(size).tolist():
                text = raw[offsets[row] : offsets[row + 1]].decode("latin-1")
                yield batch, first + row, int(size[row]), Counter(map(itemgetter(1), automaton.iter(f" {text} ")))


def counter(shared: Broadcast):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's number of documents and terms (term -1) and documents by term."""
        automaton, first, _, _ = shared.value
        holding = np.zeros(len(first) - 1, np.int64)
        documents = length = 0
        for _, _, size, found in scanned(batches, automaton):
            documents, length = documents + 1, length + size
            holding[list(found)] += 1
        used = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *used.tolist()]), pa.array([documents, *holding[used].tolist()]), pa.array([length, *[0] * len(used)])],
            names=["term", "n", "length"],
        )

    return count


def weights(total: int, holding: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(n) + 1))) for n in holding], np.int64)


def scorer(shared: Broadcast, weight: np.ndarray, total: int, length: int, limit: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's best documents of each item."""
        automaton, first, held, keys = shared.value
        whose: list[list] = [[] for _ in keys]
        pending: list[tuple] = []
        fan = np.diff(first)

        def key(entry):
            return -entry[0], entry[1] is None, entry[1] or 0

        def settle() -> None:
            scores = np.zeros((len(pending), len(keys)), np.int64)
            for line, (_, size, found) in zip(scores, pending, strict=True):
                term = np.fromiter(found.keys(), np.int64, len(found))
                tf = np.fromiter(found.values(), np.int64, len(found))
                m = 100 - 90 + (90 * size * total) // length
                worth = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                own = fan[term]
                index = np.arange(own.sum()) + np.repeat(first[term] - np.cumsum(own) + own, own)
                np.add.at(line, held[index], np.repeat(worth, own))
            floor = np.array([kept[-1][0] if len(kept) == limit else 1 for kept in whose], np.int64)
            for item in np.flatnonzero((scores >= floor).any(axis=0)).tolist():
                rows = np.flatnonzero(scores[:, item] >= floor[item])
                new = [(int(scores[row, item]), pending[row][0]) for row in rows]
                whose[item] = sorted(whose[item] + new, key=key)[:limit]
            pending.clear()

        for batch, row, size, found in scanned(batches, automaton):
            if found:
                pending.append((batch.column("doc_id")[row].as_py(), size, found))
                if len(pending) == BATCH:
                    settle()
        if pending:
            settle()
        out = [(keys[i], doc, points) for i, kept in enumerate(whose) for points, doc in kept]
        for low in range(0, len(out), 10_000):
            part = list(zip(*out[low : low + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0], pa.string()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())],
                names=["item", "doc_id", "score"],
            )

    return score


def item_blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """``items`` (item, item_id, text) dealt to blocks of at most ``block_bytes`` bytes of
    text, unless one item alone has more."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ITEM_BYTES
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(n))
        sizes = items.groupBy(block.alias("block")).agg(F.sum(size).alias("size"), F.count("*").alias("items"))
        if not sizes.where((F.col("size") > block_bytes) & (F.col("items") > 1)).take(1):
            return [items.where(block == i) for i in range(n)]
        n *= 2


def search(docs: DataFrame, items: DataFrame, limit: int = LIMIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``limit`` best documents with a score above 0."""
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of the same item_id and text are items of their own
    keyed = items.select(
        F.expr("uuid()").alias("item"), "item_id", F.col("text").cast("string").alias("text")
    )
    keyed = materialize(keyed)
    found = []
    for block in item_blocks(keyed, block_bytes):
        rows = block.select("item", "text").orderBy("item").collect()
        parts = lexicon([(r["item"], r["text"]) for r in rows])
        n_terms = len(parts[1]) - 1
        if not n_terms:
            continue
        shared = spark.sparkContext.broadcast(parts)
        counts = read.select("text").mapInArrow(counter(shared), "term long, n long, length long")
        counts = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).toArrow()
        term, n = counts.column("term").to_numpy(), counts.column("n").to_numpy()
        holding = np.zeros(n_terms, np.int64)
        holding[term[term >= 0]] = n[term >= 0]
        total = int(n[term < 0].sum())
        length = int(counts.column("length").to_numpy().sum())
        if total:
            work = scorer(shared, weights(total, holding), total, length, limit)
            found.append(read.mapInArrow(work, "item string, doc_id long, score long"))
    item_type = items.select("item_id").schema[0].dataType
    schema = T.StructType(
        [T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()),
         T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]
    )
    if not found:
        return spark.createDataFrame([], schema)
    rows = reduce(DataFrame.unionAll, found)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    slot = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SLOTS))
    first = Window.partitionBy("item", "slot").orderBy(*order)
    rows = rows.withColumn("slot", slot).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit)
    last = Window.partitionBy("item").orderBy(*order)
    rows = rows.drop("slot").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= limit)
    return rows.join(keyed.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
