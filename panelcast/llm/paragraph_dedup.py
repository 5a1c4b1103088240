"""Substring deduplication by MinHash banding of paragraphs.

Texts are cut into pieces that end with a line or with a sentence (a word ending in
``.``, ``!`` or ``?``, at least ``SENTENCE`` words after the mark before): repeated
passages are often pasted into the middle of a line, and these ends stay where they
are. What is compared are paragraphs, runs of pieces of one text:

- every piece of at least ``MIN_WORDS`` words;
- for a shorter piece, the shortest run of at least as many words that begins with it,
  and the shortest that ends with it. They depend on nothing outside of them, so a
  passage of short lines is found wherever it was pasted;
- every line, and every block between blank lines, of at least as many words.

1. Equal paragraphs meet by their hash; all but the first, in order of doc_id, text
   and place, are repeats.
2. Of each wording left, MinHash signatures of its sets of ``SHINGLE`` words are cut
   into ``BANDS`` bands of ``ROWS`` values; paragraphs that share a band are candidates,
   grouped by connected components. Those of a similarity of 0.8 meet with a probability
   of 0.995, those of 0.2 with 0.016, and nothing is compared that shares no band.
3. Within components, exact Jaccard similarity of the sets is verified; the links'
   components are clusters, of which the first paragraph stays and the others go,
   except those that overlap with the first in the same text.

The pieces of the paragraphs that go are removed. Whatever goes has its like at an
earlier place, in the one order of all steps, so the first of all stays.

Texts are shuffled once; the steps that need them read the same exchange. Components
with very many paragraphs are taken apart: those meet that have one of their rarest shingles
in common, without which they can't be similar enough.

Defined cases: texts of any length are compared whole; null and empty texts have no paragraphs and nothing removed; a text of
fewer than ``MIN_WORDS`` words always stays; a null id comes after all others; rows with the same id and
text remove from each other as one document does from itself: their first copy of a
paragraph stays in every one of them; different texts of one id come in order of a
hash; ties in order are broken by the place in the text, then the shorter is first; an empty table gives an empty result; the other columns come back as they are,
unless they have the name of a result column, which wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.components import components
from panelcast.llm.jaccard_join import dealt, link_candidates, meeting_by_rarest
from panelcast.llm.suffix_dedup import flat_lists, starts_of
from panelcast.llm.textbytes import BASE, LOWER, VISIBLE, Powers, Words, byte_class, mix, text_slices
from panelcast.session import materialize

SHINGLE = 5
PER_CENT = 80
MIN_WORDS = 10
SENTENCE = 4  # words from one mark to the next; shorter ones go with what follows
ROWS = 4
BANDS = 10
#: Paragraphs of a tile: a task compares pairs of them.
TILE_SETS = 1 << 13
#: Bytes of a key that are sent: all where equal keys mean equal paragraphs, fewer for bands,
#: whose paragraphs are compared (the bucket stands for some bits more).
WHOLE_KEY, BAND_KEY = 8, 5
#: Entries that a task holds before it deals them to buckets.
HELD = 1 << 20
LAST = 2**63 - 1
RESULTS = ("kept", "n_paragraphs", "n_removed", "n_removed_words")

ENDS = byte_class((ord("."), ord(".")), (ord("!"), ord("!")), (ord("?"), ord("?")))


class Paragraphs:
    """The pieces of a slice: words first..last and row; row r has the pieces
    begins[r]..begins[r + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: Powers) -> None:
        words = self.words = Words(LOWER[data], offsets, VISIBLE, table)
        n = len(words.hash)
        self.table = table
        self.first = self.last = self.row = self.line = self.block = np.zeros(0, np.int64)
        self.begins = np.zeros(len(offsets), np.int64)
        if not n:
            return
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        other = words.doc[1:] != words.doc[:-1]
        ends = lines[words.start[1:]] - lines[words.end[:-1]]
        line, block = np.ones(n, bool), np.ones(n, bool)
        line[:-1] = (ends > 0) | other
        block[:-1] = (ends > 1) | other
        mark = np.flatnonzero(line | ENDS[data[words.end - 1]])
        cut = line.copy()
        cut[mark[np.diff(mark, prepend=-1) >= SENTENCE]] = True
        self.last = np.flatnonzero(cut) + 1
        self.first = np.concatenate([[0], self.last[:-1]])
        self.row = words.doc[self.first]
        self.begins = np.searchsorted(self.row, np.arange(len(offsets)))
        #: pieces after which a line, a block ends
        self.line, self.block = np.flatnonzero(line[self.last - 1]), np.flatnonzero(block[self.last - 1])

    @property
    def sizes(self) -> np.ndarray:
        return self.last - self.first

    def paragraphs(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(first piece, piece after the last) of all paragraphs to be compared, in order."""
        n = len(self.first)
        if not n:
            return self.first, self.first
        at = np.arange(n)
        short = at[self.sizes < least]
        # the least run from a short piece on, and the least one up to it
        onward = np.searchsorted(self.last, self.first[short] + least) + 1
        back = np.searchsorted(self.first, self.last[short] - least, "right") - 1
        from_here = onward <= self.begins[self.row[short] + 1]
        to_here = back >= self.begins[self.row[short]]
        first = [at, short[from_here], back[to_here]]
        after = [at + 1, onward[from_here], short[to_here] + 1]
        for end in (self.line, self.block):
            first.append(np.concatenate([[0], end[:-1] + 1]))
            after.append(end + 1)
        first, after = np.concatenate(first), np.concatenate(after)
        whole = self.last[after - 1] - self.first[first] >= least
        both = np.unique(np.stack([first[whole], after[whole]]), axis=1)
        return both[0], both[1]

    def names(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Paragraphs as numbers: the first piece's place in its row, and the count of pieces."""
        return first - self.begins[self.row[first]] << 32 | after - first

    def named(self, row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The paragraphs that ``names`` gave."""
        first = self.begins[row] + (number.astype(np.int64) >> 32)
        return first, first + (number.astype(np.int64) & 0xFFFFFFFF)

    def hashes(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        low, high = self.first[first], self.last[after - 1]
        n = len(self.words.hash)
        up, down = self.table.upto(n + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words.hash * up[:n], dtype=np.uint64)])
        return mix((prefix[high] - prefix[low]) * down[low] + (high - low).astype(np.uint64))

    def grams(self) -> np.ndarray:
        """The hash of the shingle that begins with each word."""
        n = len(self.words.hash)
        total = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
        for j in range(SHINGLE):
            total = mix(total * np.uint64(BASE) + self.words.hash[j : j + len(total)])
        return total

    def shingles(self, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``first``, hash) of the distinct shingles of some paragraphs."""
        count = self.last[after - 1] - self.first[first] - SHINGLE + 1
        of = np.repeat(np.arange(len(first)), count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + self.first[first][of]
        total = self.grams()[at]
        order = np.lexsort((total, of))
        of, total = of[order], total[order]
        fresh = np.ones(len(of), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (total[1:] != total[:-1])
        return of[fresh], total[fresh]


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: the upper ones of
    small numbers are equal, which a shuffle packs into almost nothing."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplanes(data: bytes, kind: type) -> np.ndarray:
    """The numbers that ``planes`` gave."""
    rows = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T
    return np.ascontiguousarray(rows).view(kind).ravel()


def blobs(
    keys: np.ndarray, rows: np.ndarray, numbers: np.ndarray, ids: np.ndarray, tags: np.ndarray, buckets: int, width: int
):
    """A batch with a row per bucket: documents, entries of each, places and keys, all but
    the keys as ``planes``."""
    place = (keys % np.uint64(buckets)).astype(np.int64) << 32 | rows
    order = np.argsort(place)
    place, numbers = place[order], numbers[order]
    bounds = np.searchsorted(place, np.arange(buckets + 1) << 32)
    runs = starts_of(place)
    docs, counts = place[runs] & 0xFFFFFFFF, np.diff(np.append(runs, len(place))).astype(np.uint32)
    at = np.searchsorted(runs, bounds)
    by_doc = (ids[docs], tags[docs], counts)
    by_entry = ((numbers >> 32).astype(np.uint32), numbers.astype(np.uint32))
    low = np.ascontiguousarray((keys[order] >> np.uint64(64 - 8 * width)).view(np.uint8).reshape(-1, 8)[:, :width])
    columns: list[list] = [[] for _ in range(7)]
    for b in np.flatnonzero(np.diff(bounds)):
        own, doc = slice(bounds[b], bounds[b + 1]), slice(at[b], at[b + 1])
        parts = (b, *(planes(x[doc]) for x in by_doc), *(planes(x[own]) for x in by_entry), low[own].tobytes())
        for column, part in zip(columns, parts, strict=True):
            column.append(part)
    kinds = [pa.int32()] + [pa.binary()] * 6
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "ids", "tags", "counts", "numbers", "pieces", "keys"])


def held_blobs(slices: Iterator[tuple], buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """``blobs`` of (keys, rows, numbers, ids, tags) of some slices together, of about ``HELD``
    entries: a row for each slice and bucket costs more the more buckets there are."""
    held: list[tuple] = []
    for part in slices:
        # copies, as a view would keep the whole batch
        held.append((*part[:3], part[3].copy(), part[4].copy()))
        if sum(len(h[0]) for h in held) >= HELD:
            yield joined_blobs(held, buckets, width)
            held = []
    if held:
        yield joined_blobs(held, buckets, width)


def joined_blobs(held: list[tuple], buckets: int, width: int) -> pa.RecordBatch:
    before = np.cumsum([0] + [len(h[3]) for h in held])
    rows = np.concatenate([h[1] + at for h, at in zip(held, before, strict=False)])
    keys, numbers, ids, tags = (np.concatenate([h[k] for h in held]) for k in (0, 2, 3, 4))
    return blobs(keys, rows, numbers, ids, tags, buckets, width)


BLOB = "bucket int, ids binary, tags binary, counts binary, numbers binary, pieces binary, keys binary"


def unblob(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, tag, number) of all entries of a bucket, sorted."""
    kinds = {"ids": np.int64, "tags": np.int64, "counts": np.uint32, "numbers": np.uint32, "pieces": np.uint32, "keys": np.uint8}
    read = {c: [unplanes(x.as_py(), kind) for x in table.column(c)] for c, kind in kinds.items()}
    counts = np.concatenate(read["counts"])
    ids = np.repeat(np.concatenate(read["ids"]), counts)
    tags = np.repeat(np.concatenate(read["tags"]), counts)
    numbers = np.concatenate(read["numbers"]).astype(np.int64) << 32 | np.concatenate(read["pieces"])
    wide = np.zeros((len(numbers), 8), np.uint8)
    wide[:, :width] = np.concatenate(read["keys"]).reshape(-1, width)
    keys = wide.view(np.uint64).ravel()
    order = np.argsort(keys)
    equal = keys[order[1:]] == keys[order[:-1]]
    several = np.flatnonzero(np.append(equal, False) | np.concatenate([[False], equal]))
    own = order[several]
    order[several] = own[np.lexsort((numbers[own], tags[own], ids[own], keys[own]))]
    return keys[order], ids[order], tags[order], numbers[order]


def announce(buckets: int, least: int):
    """Hashes of all paragraphs to be compared."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        table = Powers()
        for batch in batches:
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            for low, high, data, offsets in text_slices(batch.column("text")):
                p = Paragraphs(data, offsets, table)
                first, after = p.paragraphs(least)
                keys, numbers = p.hashes(first, after), p.names(first, after)
                yield keys, p.row[first], numbers, ids[low:high], tags[low:high]

    return lambda batches: held_blobs(slices(batches), buckets, WHOLE_KEY)


def equal_paragraphs(table: pa.Table) -> pa.Table:
    """All but the first of equal paragraphs."""
    key, ids, tags, numbers = unblob(table, WHOLE_KEY)
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    # rows that repeat an id and text have the same first paragraph
    runs = np.flatnonzero(~again)
    head = np.repeat(runs, np.diff(np.concatenate([runs, [len(key)]])))
    again &= (ids != ids[head]) | (tags != tags[head]) | (numbers != numbers[head])
    return pa.table({"id": ids[again], "tag": tags[again], "number": numbers[again]})


def left_over(batch: pa.RecordBatch, low: int, high: int, p: Paragraphs, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Paragraphs to be compared that are no repeats of an equal one."""
    first, after = p.paragraphs(least)
    gone_first, gone_after = p.named(*flat_lists(batch.column("gone"), low, high))
    width = len(p.first) + 1
    keep = ~np.isin(first * width + after, gone_first * width + gone_after)
    return first[keep], after[keep]


def send_bands(buckets: int, least: int, bands: int, rows: int):
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        table = Powers()
        for batch in batches:
            ids, tags = batch.column("id").to_numpy(), batch.column("sent").to_numpy()
            for low, high, data, offsets in text_slices(batch.column("text")):
                p = Paragraphs(data, offsets, table)
                first, after = left_over(batch, low, high, p, least)
                if not len(first):
                    continue
                grams = np.append(p.grams(), np.uint64(0))
                # from the first shingle of each paragraph up to its last
                spans = np.stack([p.first[first], p.last[after - 1] - SHINGLE + 1], axis=1).ravel()
                keys = []
                for band in range(bands):
                    total = np.full(len(first), band + 1, np.uint64)
                    for r in range(rows):
                        # shingles are mixed already: times an odd number is a new order of them
                        odd = np.uint64(int(mix(np.array([band * rows + r + 1], np.uint64))[0]) | 1)
                        total = mix(total * np.uint64(BASE) + np.minimum.reduceat(grams * odd, spans)[::2])
                    keys.append(total)
                numbers = p.names(first, after)
                yield np.concatenate(keys), np.tile(p.row[first], bands), np.tile(numbers, bands), ids[low:high], tags[low:high]

    return lambda batches: held_blobs(slices(batches), buckets, BAND_KEY)


def band_edges(table: pa.Table) -> pa.Table:
    """Edges from the first paragraph in a band to the others. One that overlaps with
    the first goes to the next that does not, if there is any."""
    key, ids, tags, numbers = unblob(table, BAND_KEY)
    runs = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    head = np.repeat(runs, np.diff(np.concatenate([runs, [len(key)]])))
    at = np.arange(len(key))
    overlap = (ids == ids[head]) & (tags == tags[head])
    overlap &= (numbers >> 32) < (numbers[head] >> 32) + (numbers[head] & 0xFFFFFFFF)
    group = np.cumsum(head == at) - 1
    apart = np.full(len(runs), len(key))
    np.minimum.at(apart, group[~overlap], at[~overlap])
    head = np.where(overlap, apart[group], head)
    head = np.where(head < len(key), head, at)
    edge = np.flatnonzero(head != at)
    columns = {"id": ids, "tag": tags, "number": numbers}
    return pa.table({f"{side}_{c}": v[at] for side, at in (("a", head[edge]), ("b", edge)) for c, v in columns.items()})


def send_sets():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("text")):
                p = Paragraphs(data, offsets, table)
                first, after = p.named(*flat_lists(batch.column("numbers"), low, high))
                wanted = [flat_lists(batch.column(c), low, high)[1] for c in ("nodes", "roots", "tiles")]
                if not len(first):
                    continue
                of, shingle = p.shingles(first, after)
                counts = np.bincount(of, minlength=len(first))
                bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                sets = pa.ListArray.from_arrays(bounds, pa.array(shingle.view(np.int64)))
                arrays = [pa.array(x.astype(k)) for x, k in zip(wanted, (np.int64, np.int64, np.int32), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, sets], ["id", "component", "tiles", "set"])

    return run


def remove(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("text")):
                rows = high - low
                p = Paragraphs(data, offsets, table)
                change = np.zeros(len(p.row) + 1, np.int64)
                for column in ("gone", "similar"):
                    first, after = p.named(*flat_lists(batch.column(column), low, high))
                    np.add.at(change, first, 1)
                    np.add.at(change, after, -1)
                which = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                # a piece goes with the white space before the next one
                start = p.words.start[p.first[which]]
                following = np.concatenate([p.words.start, [0]])[p.last[which]]
                end_of_text = offsets[p.row[which] + 1]
                stop = np.where(p.last[which] < p.words.first[p.row[which] + 1], following, end_of_text)
                depth = np.zeros(len(data) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, stop, -1)
                drop = np.cumsum(depth[:-1]) > 0
                lost = np.diff(np.concatenate([[0], np.cumsum(drop)])[offsets])
                left = np.concatenate([[0], np.cumsum(np.diff(offsets) - lost)]).astype(np.int32)
                kept = pa.Array.from_buffers(
                    pa.string(), rows, [None, pa.py_buffer(left.tobytes()), pa.py_buffer(data[~drop].tobytes())]
                )
                removed = np.bincount(p.row[which], minlength=rows)
                words = np.bincount(p.row[which], weights=p.sizes[which], minlength=rows)
                counts = [pa.array(x.astype(np.int64)) for x in (np.diff(p.begins), removed, words)]
                own = [batch.column(c).slice(low, rows) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, kept, *counts], [*columns, *RESULTS])

    return run


def remove_similar(docs: DataFrame, per_cent: int = PER_CENT, least: int = MIN_WORDS, bands: int = BANDS, rows: int = ROWS):
    """The columns of ``docs``, kept (string: what stays), n_paragraphs (pieces),
    n_removed (of them) and n_removed_words."""
    if least < SHINGLE:
        raise ValueError(f"paragraphs of fewer than {SHINGLE} words have no shingle")
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in docs.columns if c not in RESULTS]
    inner = ["text" if c == "text" else f"own_{i}" for i, c in enumerate(columns)]
    own = docs.select(
        *[F.col(f"`{c}`").cast("string").alias(k) if c == "text" else F.col(f"`{c}`").alias(k) for c, k in zip(columns, inner, strict=True)],
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"),
    ).withColumn("tag", F.xxhash64("text"))

    equal = own.select("id", "tag", "text").mapInArrow(announce(buckets, least), BLOB)
    equal = equal.groupBy("bucket").applyInArrow(equal_paragraphs, "id long, tag long, number long")
    # an id that has one text names it alone: its bands, dealt to ever more buckets, go without the tag
    alone = own.groupBy("id").agg(F.min("tag").alias("tag"), F.max("tag").alias("last"))
    alone = materialize(alone.where((F.col("tag") == F.col("last")) & (F.col("id") != LAST)).select("id", "tag"))
    known = equal.unionByName(alone, allowMissingColumns=True).withColumn("sent", F.when(F.col("number").isNull(), 0))
    gone = materialize(
        known.groupBy("id", "tag").agg(F.collect_set("number").alias("gone"), F.min("sent").cast("long").alias("sent"))
    )
    texts = own.join(gone, ["id", "tag"], "left").withColumn("sent", F.coalesce("sent", "tag"))

    banded = texts.mapInArrow(send_bands(buckets, least, bands, rows), BLOB)
    edges = banded.groupBy("bucket").applyInArrow(
        band_edges, "a_id long, a_tag long, a_number long, b_id long, b_tag long, b_number long"
    )
    edges = materialize(edges.distinct())
    place = lambda side: F.xxhash64(f"{side}_id", f"{side}_tag", f"{side}_number")
    edges = edges.select("*", place("a").alias("a"), place("b").alias("b"))
    ends = [edges.select(*[F.col(f"{s}_{c}").alias(c) for c in ("id", "tag", "number")], F.col(s).alias("node")) for s in "ab"]
    whole_tag = alone.select("id", F.lit(0).cast("long").alias("tag"), F.col("tag").alias("whole"))
    nodes = ends[0].unionAll(ends[1]).distinct().join(whole_tag, ["id", "tag"], "left")
    nodes = materialize(nodes.select("id", F.coalesce("whole", "tag").alias("tag"), "number", "node"))
    found = components(edges.select("a", "b"))
    # tiles by number of pieces, of about 32 shingles
    pieces = F.col("number").bitwiseAND(0xFFFFFFFF)
    candidates = materialize(dealt(nodes.join(found, "node").withColumn("n", 32 * pieces), TILE_SETS))
    wanted = candidates.groupBy("id", "tag").agg(
        *[F.collect_list(c).alias(f"{c}s" if c != "tiles" else c) for c in ("number", "node", "root", "tiles")]
    )
    sets = texts.join(wanted, ["id", "tag"]).mapInArrow(
        send_sets(), "id long, component long, tiles int, set array<long>"
    )
    if (candidates.agg(F.max("tiles")).first()[0] or 0) > 1:
        sets = meeting_by_rarest(materialize(sets), per_cent, TILE_SETS)
    links = materialize(link_candidates(sets, per_cent, buckets))
    clusters = nodes.join(components(links), "node")
    first = clusters.groupBy("root").agg(F.min(F.struct("id", "tag", "number")).alias("head"))
    head_end = F.shiftright("head.number", 32) + F.col("head.number").bitwiseAND(0xFFFFFFFF)
    apart = (F.col("id") != F.col("head.id")) | (F.col("tag") != F.col("head.tag"))
    others = clusters.join(first, "root").where(apart | (F.shiftright("number", 32) >= head_end))
    similar = others.groupBy("id", "tag").agg(F.collect_set("number").alias("similar"))

    whole = texts.join(similar, ["id", "tag"], "left")
    schema = T.StructType(
        [T.StructField(k, own.schema[k].dataType) for k in inner]
        + [T.StructField("kept", T.StringType())]
        + [T.StructField(k, T.LongType()) for k in RESULTS[1:]]
    )
    return whole.mapInArrow(remove(inner), schema).toDF(*columns, *RESULTS)
