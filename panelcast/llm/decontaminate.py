"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``11011011`` hashes a run of words without those under a 0, so
an overlap survives substituted words. Hashes of all runs of all documents under
all masks meet those of the benchmark in a Spark join; around each meeting the
words of both sides are compared in place, and a pair is kept if some window of
``WINDOW`` words holds at least ``SIMILARITY`` equal ones.

Before the join, documents drop the runs that a bit filter over the benchmark's
hashes excludes. The filter has a fixed size (``FILTER_BITS``), whatever the
tables hold: a larger benchmark lets more runs through to the join, and changes
no result. Nothing else is broadcast by hint. Documents are read once and their
texts are never shuffled.

Words are runs of letters and digits, lower-cased (A-Z) ``[0-9a-z\\x80-\\xff]+``.
The masks meet every window of 9 to ``WINDOW`` words with as many substituted words as
``SIMILARITY`` allows, wherever these are (one of 9 words, two of 10 to 13), so no such
overlap is missed. An item shorter than the widest mask is looked for as a whole and without
substitutions; one with fewer than ``MIN_WORDS`` words cannot identify a
document and matches nothing.

Defined cases: null and empty texts match nothing; texts of any length are read whole; a null doc_id is carried
along; repeated rows and ids are judged row by row; repeated items each match;
empty tables give an empty result; other columns are ignored whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.textbytes import ALNUM, BASE, LOWER, Powers, Words, mix, text_slices
from panelcast.session import materialize

#: The masks; 1 marks a word that is hashed.
MASKS = ["11111", "1101011", "110010111", "1100111"]
WINDOW = 13
SIMILARITY = 0.8
MIN_WORDS = 5
REACH = 24
FILTER_BITS = 1 << 25

#: A name that documents are not expected to have.
HIT = "hash_of_contaminated_row"

SEEDS = "id long, row int, size long, at long, mask int, hash long, around array<long>"


def widest(masks: list[str]) -> int:
    return max(map(len, masks))


def all_masks(masks: list[str]) -> list[str]:
    """The masks, and whole runs for items too short for the widest."""
    return masks + ["1" * n for n in range(MIN_WORDS, widest(masks))]


def probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash."""
    bits = np.uint64(FILTER_BITS - 1)
    return (hashes & bits).astype(np.int64), (hashes >> np.uint64(38) & bits).astype(np.int64)


def seeder(masks: list[str], ids: str, pad: int, bitmap: np.ndarray | None, lengths: list[int] | None):
    """Seeds of every text; with a filter, only those that may meet another.

    ``lengths``: for documents, the item lengths that need a mask of their own.
    Without a filter (items), an item has either the masks or its own length's.
    """
    every = all_masks(masks)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            own_ids = batch.column(ids)
            for first, last, data, offsets in text_slices(batch.column("text")):
                words = Words(LOWER[data], offsets, ALNUM, table)
                size = np.diff(words.first)
                padded = np.full(len(words.hash) + 2 * REACH + widest(masks), pad, np.uint64)
                padded[REACH : REACH + len(words.hash)] = words.hash
                for number, mask in enumerate(every):
                    short = number >= len(masks)
                    if lengths is not None and short and len(mask) not in lengths:
                        continue
                    at, hashes = words.grams(mask)
                    hashes = mix(hashes + np.uint64(number * BASE % (1 << 64)))
                    if bitmap is None:
                        whole = size[words.doc[at]]
                        keep = whole == len(mask) if short else whole >= widest(masks)
                    else:
                        one, two = probes(hashes)
                        keep = bitmap[one] & bitmap[two]
                    at, hashes = at[keep], hashes[keep]
                    row = words.doc[at]
                    span = 2 * REACH + widest(masks)
                    index = at[:, None] + np.arange(span)
                    around = padded[index]
                    # words of other rows are no neighbours
                    place = index - REACH
                    around[(place < words.first[row][:, None]) | (place >= words.first[row + 1][:, None])] = pad
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.arange(len(at) + 1, dtype=np.int32) * span), pa.array(around.ravel().view(np.int64))
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            own_ids.take(pa.array(row + first)),
                            pa.array((row + first).astype(np.int32)),
                            pa.array(size[row]),
                            pa.array(at - words.first[row]),
                            pa.array(np.full(len(at), number, np.int32)),
                            pa.array(hashes.view(np.int64)),
                            lists,
                        ],
                        names=["id", "row", "size", "at", "mask", "hash", "around"],
                    )

    return seeds


def bit_filter(seeds: DataFrame) -> np.ndarray:
    """Bits of all hashes, gathered as words of 32 bits: 4 MB however many."""
    bits = F.array(
        F.col("hash").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("hash", 38).bitwiseAND(FILTER_BITS - 1)
    )
    words = (
        seeds.select(F.explode(bits).alias("bit"))
        .groupBy(F.shiftright("bit", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 31 AS INT))")).alias("bits"))
        .toArrow()
    )
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: list[str] | None = None,
    window: int = WINDOW,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row per document row and benchmark item that overlap.

    Columns: doc_id, row (a number of the document's row), item_id, n_seeds,
    first_word (of the overlap in the document), similarity (best window).
    """
    masks = masks or MASKS
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = materialize(items.mapInArrow(seeder(masks, "item_id", 1, None, None), SEEDS))
    lengths = [r[0] for r in items.where(F.col("size") < widest(masks)).select("size").distinct().collect()]
    bitmap = spark.sparkContext.broadcast(np.packbits(bit_filter(items)))

    def seeds(batches):
        bits = np.unpackbits(bitmap.value).astype(bool)
        yield from seeder(masks, "doc_id", 0, bits, lengths)(batches)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a row is known by its task and its place there, so that equal ids stay apart
    met = materialize(own.withColumn("doc_row", F.monotonically_increasing_id()).transform(_numbered, seeds))
    pairs = met.join(
        items.select(
            F.col("id").alias("item_id"),
            F.col("size").alias("item_size"),
            F.col("at").alias("item_at"),
            "mask",
            "hash",
            F.col("around").alias("item_around"),
        ),
        ["mask", "hash"],
    )
    width = F.least(F.col("item_size"), F.lit(window)).cast("int")
    equal = F.zip_with("around", "item_around", lambda a, b: (a == b).cast("int"))
    judged = pairs.select(
        "id", "doc_row", "item_id", "at", once(equal).alias("equal"), width.alias("width")
    )
    counts = F.transform(
        F.sequence(F.lit(1), F.size("equal") - F.col("width") + 1),
        lambda j: F.aggregate(F.slice("equal", j, F.col("width")), F.lit(0), lambda s, x: s + x),
    )
    judged = judged.withColumn("best", once(F.array_max(counts))).where(F.col("best") >= F.ceil(F.col("width") * similarity))
    return (
        judged.groupBy(F.col("id").alias("doc_id"), F.col("doc_row").alias("row"), "item_id")
        .agg(
            F.countDistinct("at").alias("n_seeds"),
            F.min("at").alias("first_word"),
            F.max(F.col("best") / F.col("width")).alias("similarity"),
        )
    )


def once(value: Column) -> Column:
    """The value as that of a generator. A filter that is pushed below a plain column takes
    its expression along, and that is then computed anew for every window."""
    return F.explode(F.array(value))


def _numbered(docs: DataFrame, seeds) -> DataFrame:
    """``seeds`` over the texts, each seed with its row's ``doc_row``."""

    def run(batches):
        for batch in batches:
            numbers = batch.column("doc_row")
            for out in seeds([batch]):
                yield out.append_column("doc_row", numbers.take(out.column("row")))

    return docs.mapInArrow(run, SEEDS + ", doc_row long")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that overlap with no benchmark item, columns as given.

    Rows are known by a hash of doc_id and text, as the verdict follows from the text:
    one row's does not fall on others with a null or the same doc_id.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").cast("string"))
    rows = docs.select(key.alias("doc_id"), "text")
    found = contaminated(rows, benchmark).select(F.col("doc_id").alias(HIT)).distinct()
    return docs.join(found, key == F.col(HIT), "left_anti")
