"""N-gram Jaccard self-join with signature trees.

Documents are sets of word shingles. Equal sets are one class. Other links, all of
them and nothing approximate, are found in three steps:

1. If two sets have a similarity of at least the threshold, their difference has at
   most D elements, which depends on their sizes. Each set is dealt by a hash of the
   shingle into D + 1 + 2e segments, so at least 2e + 1 segments of two linked sets are
   equal. A set leaves out its e weakest segments, empty ones first and then those of
   passages that texts of a bounded sample share, and sends a key for each other one, for
   its own range of sizes and the next. Two linked sets still share a key, whatever they
   leave out; sets that share a key are candidates.
2. Candidates are grouped by connected components. A component with more than ``TILE``
   shingles or ``TILE_SETS`` sets is taken apart: its sets meet by their edges, each at the
   smaller end, so whatever shares a key still meets and the work grows with the edges.
   A smaller end with more than that around it is dealt into tiles, and every pair of tiles
   is a task of its own, so no task holds more than two tiles.
3. In a task the sets are leaves of a signature tree: its nodes hold the OR of their
   sets' bitmaps and the range of sizes. Two nodes are walked together unless their
   maximum possible overlap, common bits plus the shingles that fell on taken bits,
   is too small for their sizes, or all their sets are connected already. What is
   left at the leaves is compared exactly.

The links' connected components give the result. Texts are shuffled once, to leave one of
each class; those of candidates are sent to their tiles as sets of shingles, found among
all texts by a broadcast of the candidates' ids, or if these take more than
``BROADCAST_BYTES`` by a second shuffle. Shingles are 64-bit hashes of words.

Defined cases: a text without words (or null) has an empty set and is linked with
nothing; one with fewer words than a shingle has them all as its only one; rows with
the same doc_id are one document with several texts, linked through its id; rows with
a null id are one such document, which comes after all others; ties do not matter,
as links and components do not depend on order; texts of any length are shingled whole, one
at a time; an empty table gives an empty
result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.components import components
from panelcast.llm.textbytes import BASE, LOWER, VISIBLE, Powers, Words, list_array, mix, text_slices
from panelcast.session import materialize

SHINGLE = 3
PER_CENT = 90
LAST = 2**63 - 1
TILE = 1 << 21
#: Sets of a tile: a task compares pairs of them.
TILE_SETS = 1 << 12
BITS = 2048
#: Candidates are broadcast while they take no more.
BROADCAST_BYTES = 32 << 20
CANDIDATE_BYTES = 64
GROUP_BYTES = 32
#: Documents with one key of which every pair is an edge of its own.
PAIRED = 16
#: Texts among which frequent shingles are looked for, bits of their filter, and the share
#: of a text's shingles that may be frequent without any loss of speed.
SAMPLE = 1 << 14
FILTER_BITS = 1 << 25
FREQUENT = 0.25
FANOUT = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, table: Powers, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles, sorted."""
    words = Words(LOWER[data], offsets, VISIBLE, table)
    at, hashes = words.grams("1" * size)
    rows, values = [words.doc[at]], [hashes]
    count = np.diff(words.first)
    for few in range(1, size):
        at, hashes = words.grams("1" * few)
        whole = count[words.doc[at]] == few
        rows.append(words.doc[at][whole])
        values.append(hashes[whole])
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums modulo 2**64 of sorted rows' values."""
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    bounds = np.searchsorted(row, np.arange(rows + 1))
    return upto[bounds[1:]] - upto[bounds[:-1]]


def bitmaps(row: np.ndarray, value: np.ndarray, n: np.ndarray) -> pa.Array:
    """A bitmap of each row's shingles, of a power of two of bits, at least as many."""
    width = 1 << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(width >> 3)])
    bits = np.zeros(begin[-1], np.uint8)
    bit = (value & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_or.at(bits, begin[row] + (bit >> 3), np.uint8(1) << (bit & 7).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(begin.astype(np.int32).tobytes()), pa.py_buffer(bits.tobytes())])


def describe(size: int):
    """Each row's number of shingles, two independent sums over its set, and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                row, value = shingle_sets(data, offsets, table, size)
                n = np.bincount(row, minlength=last - first).astype(np.int64)
                one, two = mix(value), mix(value ^ np.uint64(BASE))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, last - first),
                        batch.column("tag").slice(first, last - first),
                        pa.array(n),
                        pa.array(sums(row, one, last - first).view(np.int64)),
                        pa.array(sums(row, two, last - first).view(np.int64)),
                        bitmaps(row, value, n),
                    ],
                    names=["id", "tag", "n", "one", "two", "bits"],
                )

    return run


def ranges(largest: int, share: Fraction) -> np.ndarray:
    """Bounds of size ranges, each at most 1 / share times as long as it begins:
    two linked sets are in the same range or in neighbouring ones."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] / share) + 1))
    return np.array(bounds)


def segments(bounds: np.ndarray, of: int, share: Fraction) -> tuple[int, int]:
    """(segments, segments a set leaves out) for sets of the range number ``of`` and the one before.

    Of two linked sets of at most ``top`` elements, |difference| <= (a + b)(1 - s) / (1 + s)
    elements touch as many segments at most. If each set leaves out ``spare``, whichever it
    likes, 2 * ``spare`` + 1 untouched ones are enough for one that both send. As many are
    spare as random dealing leaves empty, or with ``FREQUENT`` of the elements' kind only,
    in the smallest sets of the range.
    """
    top, least = int(bounds[of + 1]) - 1, int(bounds[of])
    touched = 2 * top * (share.denominator - share.numerator) // (share.denominator + share.numerator)
    spare = int(touched >= 4)
    while spare < top // 8:
        parts = touched + 1 + 2 * spare
        need = math.ceil(parts * (1 - 1 / parts) ** (least * (1 - FREQUENT)) - 0.1)
        if need <= spare:
            break
        spare = min(need, top // 8)
    return touched + 1 + 2 * spare, spare


def segment_keys(
    row: np.ndarray, value: np.ndarray, share: Fraction, frequent: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the segments of sorted sets, for the own range and the next.

    Each set leaves out the spare number of its weakest segments: empty ones, then those
    with nothing but shingles that the bit filter ``frequent`` has.
    """
    if not len(row):
        return row, value
    n = np.bincount(row)
    bounds = ranges(int(n.max()) * 2 + 2, share)
    own = np.searchsorted(bounds, n, "right") - 1
    rare = np.ones(len(value), bool) if frequent is None else ~is_frequent(value, frequent)
    rows, keys = [], []
    for step in (0, 1):
        shapes = {of: segments(bounds, of, share) for of in {o + step for o in own[n > 0].tolist()}}
        parts, spare = (np.array([shapes[of + step][k] if size else 0 for of, size in zip(own.tolist(), n.tolist())]) for k in (0, 1))
        segment = (mix(value + np.uint64(BASE)) % parts[row].astype(np.uint64)).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(parts)])
        slot = begin[row] + segment
        # a set of hashes by its sum; the slot and range tell segments apart
        total = np.zeros(begin[-1], np.uint64)
        np.add.at(total, slot, mix(value))
        strength = np.zeros(begin[-1], np.int8)
        strength[slot] = 1
        strength[slot[rare]] = 2
        of = np.repeat(np.arange(len(n)), parts)
        number = np.arange(begin[-1]) - begin[of]
        weakest = np.lexsort((strength, of))
        used = np.sort(weakest[number >= spare[of]])
        of, total = of[used], total[used]
        shape = ((own[of] + step) << 40 | number[used]).astype(np.uint64)
        rows.append(of)
        keys.append(mix(total + mix(shape + np.uint64(1))))
    return np.concatenate(rows), np.concatenate(keys)


def probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each shingle."""
    bits = np.uint64(FILTER_BITS - 1)
    return (hashes & bits).astype(np.int64), (hashes >> np.uint64(38) & bits).astype(np.int64)


def is_frequent(value: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    one, two = probes(value)
    return frequent[one] & frequent[two]


def single_shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                value = shingle_sets(data, offsets, table, size)[1]
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64))], names=["shingle"])

    return run


def frequent_shingles(sample: DataFrame, size: int) -> np.ndarray:
    """A bit filter of the shingles that two different texts of the sample share.

    It decides which segments a set leaves out, so it changes the number of candidates and
    no result. Its size is fixed.
    """
    shared = sample.mapInArrow(single_shingles(size), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    bits = F.array(F.col("shingle").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("shingle", 38).bitwiseAND(FILTER_BITS - 1))
    words = shared.select(F.explode(bits).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 31 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def send_keys(buckets: int, size: int, share: Fraction, frequent: np.ndarray | None = None):
    packed = None if frequent is None else np.packbits(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        known = None if packed is None else np.unpackbits(packed).astype(bool)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for first, last, data, offsets in text_slices(batch.column("text")):
                row, key = segment_keys(*shingle_sets(data, offsets, table, size), share, known)
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((row, bucket))
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(bounds))
                names, owners, counts, blobs = [], [], [], []
                for b in used:
                    own = order[bounds[b] : bounds[b + 1]]
                    rows, count = np.unique(row[own], return_counts=True)
                    names.append(b)
                    owners.append(ids[first:last][rows].tobytes())
                    counts.append(count.astype(np.uint16 if count.max() < 1 << 16 else np.uint32).tobytes())
                    # the bucket stands for some bits of the key: six bytes are enough
                    low = (key[own] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
                    blobs.append(low.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int32()),
                        pa.array(owners, pa.binary()),
                        pa.array(counts, pa.binary()),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["bucket", "ids", "counts", "keys"],
                )

    return run


def shared_keys(table: pa.Table) -> pa.Table:
    """Edges between the documents with a key: of up to ``PAIRED`` documents all pairs, each
    of which can be ruled out by itself; of more, a star around the smallest one."""
    ids, keys = [], []
    for owners, counts, blob in zip(*(table.column(c) for c in ("ids", "counts", "keys")), strict=True):
        own = np.frombuffer(owners.as_py(), np.int64)
        raw = counts.as_py()
        ids.append(np.repeat(own, np.frombuffer(raw, np.uint16 if len(raw) == 2 * len(own) else np.uint32)))
        wide = np.zeros((len(ids[-1]), 8), np.uint8)
        wide[:, :6] = np.frombuffer(blob.as_py(), np.uint8).reshape(-1, 6)
        keys.append(wide.view(np.uint64).ravel())
    node, key = np.concatenate(ids), np.concatenate(keys)
    order = np.lexsort((node, key))
    node, key = node[order], key[order]
    runs = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([runs, [len(key)]]))
    large = np.repeat(sizes > PAIRED, sizes)
    center = np.repeat(node[runs], sizes)
    found = [(center[large], node[large], True)]
    ends = np.repeat(runs + sizes, sizes)
    for step in range(1, PAIRED):
        at = np.flatnonzero(~large & (np.arange(len(node)) + step < ends))
        found.append((node[at], node[at + step], False))
    columns = [np.concatenate([f[k] if k < 2 else np.full(len(f[0]), f[2]) for f in found]) for k in range(3)]
    columns = [c[columns[0] != columns[1]] for c in columns]
    pairs = np.unique(np.stack([np.minimum(columns[0], columns[1]), np.maximum(columns[0], columns[1]), columns[2]]), axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1], "star": pairs[2].astype(bool)})


def may_link(per_cent: int):
    """Edges whose sets may be similar enough by their sizes and bitmaps. Edges of stars,
    and documents without one bitmap (several sets), stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            star, n_a, n_b = (batch.column(c).to_pylist() for c in ("star", "n_a", "n_b"))
            keep = []
            for own, x, y, a, b in zip(star, n_a, n_b, batch.column("bits_a"), batch.column("bits_b"), strict=True):
                if own or x is None or y is None:
                    keep.append(True)
                    continue
                needed = -(-(x + y) * per_cent // (100 + per_cent))
                if min(x, y) < needed:
                    keep.append(False)
                    continue
                left, right = (np.frombuffer(v.as_py(), np.uint64) for v in (a, b))
                while len(left) > len(right):
                    left = left[: len(left) // 2] | left[len(left) // 2 :]
                while len(right) > len(left):
                    right = right[: len(right) // 2] | right[len(right) // 2 :]
                # an overlap may have as many more as fell on bits that were taken
                extra = min(x - int(np.bitwise_count(left).sum()), y - int(np.bitwise_count(right).sum()))
                keep.append(int(np.bitwise_count(left & right).sum()) + extra >= needed)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def send_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                row, value = shingle_sets(data, offsets, table, size)
                counts = np.bincount(row, minlength=last - first)
                own = [batch.column(c).slice(first, last - first) for c in ("id", "groups")]
                yield pa.RecordBatch.from_arrays(
                    [*own, list_array(value.view(np.int64), counts)], names=["id", "groups", "set"]
                )

    return run


class SignatureTree:
    """Sets in leaves of ``FANOUT``, and above them nodes of as many children."""

    def __init__(self, sets: list[np.ndarray], nodes: np.ndarray, per_cent: int) -> None:
        self.sets, self.nodes, self.per_cent = sets, nodes, per_cent
        self.parent = np.arange(len(sets))
        self.size = np.array([len(s) for s in sets])
        bits = np.zeros((len(sets), BITS // 64), np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        bit = (np.concatenate(sets) & np.uint64(BITS - 1)).astype(np.int64)
        np.bitwise_or.at(bits, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        self.bits = bits
        #: shingles that fell on a bit already taken: an overlap may have as many more
        self.extra = self.size - np.bitwise_count(bits).sum(axis=1)
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def needed(self, total):
        """The least overlap of two linked sets of ``total`` elements together."""
        return -(-total * self.per_cent // (100 + self.per_cent))

    def link(self, x: int, y: int) -> bool:
        common = len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))
        if 100 * common < self.per_cent * (self.size[x] + self.size[y] - common):
            return False
        self.parent[max(self.root(x), self.root(y))] = min(self.root(x), self.root(y))
        self.links.append((int(self.nodes[x]), int(self.nodes[y])))
        return True

    def possible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs of sets whose maximum possible overlap is large enough."""
        over = np.bitwise_count(self.bits[x] & self.bits[y]).sum(axis=1) + np.minimum(self.extra[x], self.extra[y])
        over = np.minimum(over, np.minimum(self.size[x], self.size[y]))
        return over >= self.needed(self.size[x] + self.size[y])

    def build(self) -> None:
        """Levels of (bitmaps, smallest, largest, extra, common root or -1)."""
        roots = np.array([self.root(x) for x in range(len(self.sets))])
        level = (self.bits, self.size, self.size, self.extra, roots)
        self.levels = [level]
        while len(level[0]) > 1:
            starts = np.arange(0, len(level[0]), FANOUT)
            bits, small, large, extra, root = level
            low, high = np.minimum.reduceat(root, starts), np.maximum.reduceat(root, starts)
            level = (
                np.bitwise_or.reduceat(bits, starts, axis=0),
                np.minimum.reduceat(small, starts),
                np.maximum.reduceat(large, starts),
                np.maximum.reduceat(extra, starts),
                np.where((low == high) & (low >= 0), low, -1),
            )
            self.levels.append(level)

    def join(self) -> list[tuple[int, int]]:
        """Links that connect whatever is connected (not every link there is)."""
        n = len(self.sets)
        # The set that is nearest to the middle of all goes first: in a group of
        # copies this connects nearly all of them.
        middle = int(np.argmax(np.bitwise_count(self.bits & self.bits[n // 2]).sum(axis=1))) if n > 2 else 0
        others = np.delete(np.arange(n), middle)
        for y in others[self.possible(np.full(len(others), middle), others)]:
            if self.root(middle) != self.root(int(y)):
                self.link(middle, int(y))
        if n > 2:
            self.build()
            top = len(self.levels) - 1
            stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
            while stack:
                self.step(stack, *stack.pop())
        return self.links

    def step(self, stack: list, level: int, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs of nodes of one level: prune, then go down or compare."""
        bits, small, large, extra, root = self.levels[level]
        if level == 0:
            keep = self.possible(a, b) & (a != b)
            for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
                if self.root(x) != self.root(y):
                    self.link(x, y)
            return
        over = np.bitwise_count(bits[a] & bits[b]).sum(axis=1) + np.minimum(extra[a], extra[b])
        over = np.minimum(over, np.minimum(large[a], large[b]))
        keep = over >= self.needed(small[a] + small[b])
        keep &= (100 * large[a] >= self.per_cent * small[b]) & (100 * large[b] >= self.per_cent * small[a])
        keep &= (root[a] < 0) | (root[a] != root[b])
        a, b = a[keep], b[keep]
        below = len(self.levels[level - 1][0])
        child = np.arange(FANOUT)
        for low in range(0, len(a), 256):
            x = (a[low : low + 256, None] * FANOUT + child)[:, :, None]
            y = (b[low : low + 256, None] * FANOUT + child)[:, None, :]
            x, y = (v.ravel() for v in np.broadcast_arrays(x, y))
            real = (x < below) & (y < below) & (x <= y)
            if real.any():
                stack.append((level - 1, x[real], y[real]))


def join_sets(per_cent: int):
    """Links of all components (and pairs of tiles) that fell into a bucket."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group = table.column("component").to_numpy()
        pair = table.column("pair").to_numpy()
        ids = table.column("id").to_numpy()
        lists = table.column("set").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        bounds = lists.offsets.to_numpy()
        values = lists.values.to_numpy().view(np.uint64)
        size = np.diff(bounds)
        order = np.lexsort((ids, size, pair, group))
        new = np.ones(len(order), bool)
        new[1:] = (group[order][1:] != group[order][:-1]) | (pair[order][1:] != pair[order][:-1])
        starts = np.flatnonzero(new)
        links: list[tuple[int, int]] = []
        for low, high in zip(starts, [*starts[1:], len(order)], strict=True):
            own = order[low:high]
            if len(own) == 2 and 100 * size[own[0]] < per_cent * size[own[1]]:
                continue
            if len(own) > 1:
                sets = [values[bounds[r] : bounds[r + 1]] for r in own]
                links += SignatureTree(sets, ids[own], per_cent).join()
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def dealt(candidates: DataFrame, tile_sets: int = TILE_SETS) -> DataFrame:
    """Adds the number of tiles of each component (root) of sets of ``n`` elements: a tile
    has about ``TILE`` elements and ``tile_sets`` sets at most."""
    least = F.greatest(F.ceil(F.sum("n") / TILE), F.ceil(F.count("*") / tile_sets))
    weight = candidates.groupBy("root").agg(least.cast("int").alias("tiles"))
    return candidates.join(weight, "root")


def meeting(candidates: DataFrame, edges: DataFrame, tile_sets: int = TILE_SETS) -> DataFrame:
    """(node, component, tiles): where the sets (node, root, n) meet. A component of one tile is
    a group; in a larger one every smaller end of edges (a, b) is, with what it has edges to.

    Sets meet if an edge or a third set, smaller than both, connects them.
    """
    weighed = materialize(dealt(candidates.select("node", "root", "n"), tile_sets))
    large = weighed.where("tiles > 1").select("node", "n")
    ends = edges.select(F.col("a").alias("root"), F.col("b").alias("node"))
    ends = ends.unionAll(edges.select(F.col("a").alias("root"), F.col("a").alias("node"))).distinct()
    groups = weighed.where("tiles = 1").unionByName(dealt(ends.join(large, "node"), tile_sets))
    return groups.select("node", F.col("root").alias("component"), "tiles")


def meeting_by_rarest(sets: DataFrame, per_cent: int, tile_sets: int = TILE_SETS) -> DataFrame:
    """The sets (id, component, tiles, set); those of a component of several tiles once for each
    group of theirs instead, if that sends them less often than its tiles.

    A group is the sets that have an element among their rarest, in one order of the component's
    elements by the sets that have them. Two sets that may be linked overlap in ``per_cent`` of
    the elements of either, so they have one in common among as many rarest as are left and one
    more. Elements that no other set has take their places there, but are no group.
    """
    large = sets.where("tiles > 1").select("id", "component", "tiles", "set", F.size("set").alias("n"))
    elements = large.select("id", "component", "n", F.explode("set").alias("element"))
    counted = elements.groupBy("component", "element").agg(F.count("*").alias("many")).where("many > 1")
    shared = elements.join(counted, ["component", "element"]).groupBy("id", "component", "n")
    shared = shared.agg(F.sort_array(F.collect_list(F.struct("many", "element"))).alias("shared"))
    places = F.expr(f"CAST(n - (n * {per_cent} + 99) DIV 100 + 1 - (n - size(shared)) AS INT)")
    rarest = shared.withColumn("places", places).where("places > 0")
    rarest = materialize(rarest.select("id", "n", "component", F.slice("shared.element", F.lit(1), F.col("places")).alias("rarest")))
    # near copies have all their rarest in common: tiles send them less often
    copies = rarest.groupBy("component").agg(F.sum(F.size("rarest")).alias("copies"))
    tiled = large.groupBy("component").agg((F.count("*") * (F.max("tiles") - 1)).alias("tiled"))
    apart = tiled.join(copies, "component", "left").where("coalesce(copies, 0) < tiled").select("component")
    apart = F.broadcast(materialize(apart))  # at most a row for ``tile_sets`` sets
    groups = rarest.join(apart, "component").select("id", "n", "component", F.explode("rarest").alias("element"))
    groups = materialize(groups.select("id", "n", F.xxhash64("component", "element").alias("root")))
    several = groups.groupBy("root").count().where("count > 1").select("root")
    groups = dealt(groups.join(several, "root"), tile_sets).select("id", F.col("root").alias("component"), "tiles")
    sent = large.select("id", "set").join(groups, "id")
    whole = sets.where("tiles = 1").unionByName(large.join(apart, "component", "left_anti").drop("n"))
    return whole.select("id", "component", "tiles", "set").unionByName(sent)


def link_candidates(sets: DataFrame, per_cent: int, buckets: int) -> DataFrame:
    """Links (a, b) between the sets (id, component, tiles, set) of each group."""
    # with several tiles, a set goes to each pair that its own tile is part of
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: (t != F.col("tile")) | (F.col("tiles") == 1)),
        lambda t: F.least(t, F.col("tile")) * F.col("tiles") + F.greatest(t, F.col("tile")),
    )
    sets = sets.withColumn("tile", own).withColumn("pair", F.explode(pairs))
    bucket = F.pmod(F.xxhash64("component", "pair"), F.lit(4 * buckets))
    dealt_out = sets.select("component", "pair", "id", "set").withColumn("bucket", bucket)
    return dealt_out.groupBy("bucket").applyInArrow(join_sets(per_cent), "a long, b long").distinct()


def similar_documents(docs: DataFrame, size: int = SHINGLE, per_cent: int = PER_CENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id for every row; links between classes)."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = Fraction(per_cent, 100)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tag", F.xxhash64("text"))
    described = materialize(rows.mapInArrow(describe(size), "id long, tag long, n long, one long, two long, bits binary"))
    classes = described.where("n > 0").groupBy("one", "two", "n")
    classes = classes.agg(F.min(F.struct("id", "tag")).alias("best"), F.min("bits").alias("bits"))
    classes = classes.select("one", "two", "n", "best.id", "best.tag", "bits")
    # a set is a node by itself, with a name of its own where its id has several
    several = classes.groupBy("id").agg(F.count("*").alias("sets")).where("sets > 1")
    named = F.when(F.col("sets").isNull(), F.col("id")).otherwise(F.xxhash64("id", "tag"))
    classes = materialize(classes.join(several, "id", "left").withColumn("node", named).drop("sets"))

    drawn = classes.orderBy(F.xxhash64("id", "tag"), "id", "tag").limit(SAMPLE).select("id", "tag")
    frequent = frequent_shingles(rows.join(F.broadcast(drawn), ["id", "tag"]).dropDuplicates(["id", "tag"]).select("text"), size)

    # one text for each class
    chosen = rows.join(classes.select("id", "tag", "node").distinct(), ["id", "tag"])
    keys = chosen.select(F.col("node").alias("id"), "text").mapInArrow(
        send_keys(buckets, size, share, frequent), "bucket int, ids binary, counts binary, keys binary"
    )
    edges = keys.groupBy("bucket").applyInArrow(shared_keys, "a long, b long, star boolean")
    edges = edges.groupBy("a", "b").agg(F.max("star").alias("star"))
    single = classes.groupBy("node").agg(F.count("*").alias("sets"), F.min("n").alias("n"), F.min("bits").alias("bits"))
    single = single.where("sets = 1")
    pairs = edges = materialize(edges)
    for side in "ab":
        known = single.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
        pairs = (pairs if side == "b" else pairs.where(~F.col("star"))).join(known, side, "left")
    pairs = pairs.select("a", "b", "star", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(may_link(per_cent), "a long, b long")
    edges = materialize(edges.where("star").select("a", "b").unionAll(pairs))
    candidates = components(edges).join(classes.groupBy("node").agg(F.sum("n").alias("n")), "node")
    groups = meeting(candidates, edges).groupBy("node").agg(F.collect_list(F.struct("component", "tiles")).alias("groups"))
    candidates = materialize(groups.join(classes.select("id", "tag", "node").distinct(), "node"))
    size_of = candidates.agg(F.coalesce(F.sum(CANDIDATE_BYTES + GROUP_BYTES * F.size("groups")), F.lit(0))).first()[0]
    if size_of <= BROADCAST_BYTES:
        candidates = F.broadcast(candidates)  # their texts then need no second shuffle
    sets = rows.join(candidates, ["id", "tag"]).select(F.col("node").alias("id"), "groups", "text")
    sets = sets.mapInArrow(send_sets(size), "id long, groups array<struct<component: long, tiles: int>>, set array<long>")
    sets = sets.withColumn("group", F.explode("groups")).select("id", "group.component", "group.tiles", "set")
    links = link_candidates(sets, per_cent, buckets)
    for side in "ab":
        links = links.join(classes.select(F.col("node").alias(side), F.col("id").alias(f"{side}_id")).distinct(), side)
    links = materialize(links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct())

    # a document with several texts connects their classes
    member = described.join(
        classes.select("one", "two", "n", F.col("id").alias("class")), ["one", "two", "n"], "left"
    ).select("id", F.col("n").alias("n_shingles"), F.coalesce("class", "id").alias("class"))
    repeated = described.groupBy("id").count().where("count > 1").select("id")
    bridges = member.join(repeated, "id").where("id <> class").select(F.col("id").alias("a"), F.col("class").alias("b"))
    found = components(links.unionAll(bridges))
    labelled = member.join(found, member["class"] == found["node"], "left")
    component = F.coalesce("root", "class")
    return labelled.select(
        F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"),
        "n_shingles",
        F.when(component != LAST, component).alias("component_id"),
    ), links
