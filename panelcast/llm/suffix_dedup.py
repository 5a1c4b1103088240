"""Removal of repeated substrings by hash-compared suffix sorting.

A byte is removed if it is covered by a string of ``LENGTH`` bytes that also starts
in a document with a smaller id. A distributed suffix array of all positions would
move some hundred times the corpus, so texts are first cut into *pieces* by a rule
that looks at nothing but the bytes themselves: of the runs of ``SEED`` bytes in a
window of ``LENGTH`` bytes the one with the smallest hash (of equals the first) owns
the window, and neighbouring windows of one owner are a piece. Equal windows have
equal owners at the same place, so only pieces with the same owner can share one.

1. Every piece sends its owner's hash, a fingerprint, a byte of hash for what stands
   on either side of the owner, and its place to a bucket. There, pieces with a
   fingerprint that a smaller document has too are repeats as a whole, and pieces
   that share an owner with no other, or no side of it, are done with.
2. What is left, the first pieces of each wording of an owner with several wordings,
   sends its bytes. Their windows are sorted as suffixes: merge sort, where two
   suffixes are compared by their common extension, found by binary search over
   prefix polynomial hashes, and the byte after it. Windows whose own hash no other one
   has equal none and are not sorted. Neighbours that agree in
   ``LENGTH`` bytes are compared byte by byte before they count as equal; should
   hashes ever collide, the table is sorted by its bytes instead.
3. Repeats go back to their documents, which drop the bytes they cover.

Texts are shuffled once (both steps that need them read the same exchange). Work
per bucket grows with the pieces that share an owner, one entry of some 16 bytes for
each; their number in a bucket is that of the corpus over the shuffle partitions,
plus, for a passage that very many documents share, one per document.

Defined cases: null and empty texts have no bytes and nothing removed, as have texts
shorter than ``LENGTH``; a null id counts as larger than all others; rows with equal
ids do not remove from each other, whatever their texts; an empty table gives an
empty result; texts may be of any length; the other columns come back as they are,
unless they have the name of a result column, which wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.textbytes import BASE, Powers, mix, prefix_hashes, slices, text_slices
from panelcast.session import materialize

LENGTH = 50
SEED = 16
LAST = 2**63 - 1
#: Room for a position next to its hash while the smallest hash is looked for.
PLACE_BITS = 30
RESULTS = ("kept", "n_bytes", "n_removed", "n_spans")
#: Entries that a task holds before it deals them to buckets.
HELD = 1 << 19


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Pieces:
    """The pieces of a slice: first and last window, owner and its hash, fingerprint."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: Powers, length: int, seed: int) -> None:
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.owner = self.row = empty
        self.key = self.print = self.left = self.right = np.zeros(0, np.uint64)
        starts = len(data) - length + 1
        if starts <= 0:
            return
        prefix = prefix_hashes(data, table)
        _, down = table.upto(len(data) + 1)
        n = len(data) - seed + 1
        hashes = mix((prefix[seed:] - prefix[:n]) * down[:n])
        place = np.uint64((1 << PLACE_BITS) - 1)
        packed = (hashes & ~place) | np.arange(n, dtype=np.uint64)
        owner = (sliding_min(packed, length - seed + 1) & place).astype(np.int64)
        # windows that run over the end of their text do not exist
        inside = np.zeros(starts + 1, np.int64)
        sizes = np.diff(offsets)
        whole = sizes >= length
        np.add.at(inside, offsets[:-1][whole], 1)
        np.add.at(inside, offsets[1:][whole] - length + 1, -1)
        window = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(window):
            return
        owner = owner[window]
        cut = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        self.first = window[np.concatenate([[0], cut])]
        self.last = window[np.concatenate([cut - 1, [len(window) - 1]])]
        self.owner = owner[np.concatenate([[0], cut])]
        self.row = np.searchsorted(offsets, self.first, "right") - 1
        self.key = hashes[self.owner]
        whole_hash = (prefix[self.last + length] - prefix[self.first]) * down[self.first]
        shape = ((self.owner - self.first) << 8 | (self.last - self.first)).astype(np.uint64)
        self.print = mix(whole_hash + mix(shape + np.uint64(1)) * np.uint64(BASE))
        # a window holds half of its bytes besides the owner on one side of it at least
        half = (length - seed) // 2
        begin, end = self.owner, self.owner + seed
        far = offsets[self.row + 1]
        near, stop = np.maximum(begin - half, offsets[self.row]), np.minimum(end + half, far)
        self.left = mix((prefix[begin] - prefix[near]) * down[near])
        self.right = mix((prefix[stop] - prefix[end]) * down[end])


def planes(values: np.ndarray) -> bytes:
    """Integers byte by byte, lowest bytes first: equal high bytes compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(blob: memoryview, dtype: type, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, n).T).view(dtype).ravel()


#: An entry of a bucket, field by field; the first three are per document.
DOC_FIELDS = (("id", np.int64), ("tag", np.int64), ("count", np.uint32))
FIELDS = (
    ("key", np.uint32),
    ("high", np.uint32),
    ("low", np.uint16),
    ("left", np.uint8),
    ("right", np.uint8),
    ("first", np.uint32),
    ("owner", np.uint8),
    ("span", np.uint8),
)  # high and low are 48 bits of the fingerprint; with the key's they tell pieces apart


def pack_bucket(docs: dict[str, np.ndarray], entries: dict[str, np.ndarray]) -> bytes:
    n_docs, n = len(docs["id"]), len(entries["key"])
    out = [np.array([n_docs, n], np.int64).tobytes()]
    out += [planes(docs[name].astype(kind)) for name, kind in DOC_FIELDS]
    out += [planes(entries[name].astype(kind)) for name, kind in FIELDS]
    return b"".join(out)


def unpack_bucket(blob: bytes) -> dict[str, np.ndarray]:
    view = memoryview(blob)
    n_docs, n = np.frombuffer(view[:16], np.int64).tolist()
    at, out = 16, {}
    for fields, rows in ((DOC_FIELDS, n_docs), (FIELDS, n)):
        for name, kind in fields:
            size = np.dtype(kind).itemsize * rows
            out[name] = unplanes(view[at : at + size], kind, rows)
            at += size
    count = out.pop("count")
    return {k: np.repeat(v, count) if k in ("id", "tag") else v for k, v in out.items()}


def bucketed(held: list[tuple], buckets: int) -> pa.RecordBatch:
    """A row for each bucket: its entries out of some slices, each of them (ids, tags, row and
    bucket of an entry, fields)."""
    before = np.cumsum([0] + [len(h[0]) for h in held])
    ids, tags = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    bucket = np.concatenate([h[3] for h in held])
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    row = np.concatenate([h[2] + at for h, at in zip(held, before, strict=False)])[order]
    fields = {name: np.concatenate([h[4][name] for h in held])[order] for name, _ in FIELDS}
    names, blobs = [], []
    for b in np.flatnonzero(np.diff(bounds)):
        own = slice(bounds[b], bounds[b + 1])
        first = starts_of(row[own])
        rows = row[own][first]
        counts = np.diff(np.append(first, bounds[b + 1] - bounds[b]))
        names.append(b)
        blobs.append(pack_bucket({"id": ids[rows], "tag": tags[rows], "count": counts}, {k: v[own] for k, v in fields.items()}))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def announce(buckets: int, length: int, seed: int):
    """Step 1, at the texts: entries for each bucket, in rows of about ``HELD`` entries together,
    as a row for each slice and bucket costs more the more buckets there are."""
    number = np.min_scalar_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, entries = Powers(), [], 0
        for batch in batches:
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            for first, last, data, offsets in text_slices(batch.column("text")):
                p = Pieces(data, offsets, table, length, seed)
                found = {
                    "key": p.key & np.uint64(0xFFFFFFFF),
                    "high": p.print >> np.uint64(32),
                    "low": p.print & np.uint64(0xFFFF),
                    "left": p.left & np.uint64(0xFF),
                    "right": p.right & np.uint64(0xFF),
                    "first": p.first - offsets[p.row],
                    "owner": p.owner - p.first,
                    "span": p.last - p.first,
                }
                found = {name: found[name].astype(kind) for name, kind in FIELDS}
                bucket = ((p.key >> np.uint64(32)) % np.uint64(buckets)).astype(number)
                # copies, as a view would keep the whole batch
                held.append((ids[first:last].copy(), tags[first:last].copy(), p.row, bucket, found))
                entries += len(bucket)
                if entries >= HELD:
                    yield bucketed(held, buckets)
                    held, entries = [], 0
        if held:
            yield bucketed(held, buckets)

    return run


def starts_of(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def compare_pieces(table: pa.Table) -> pa.Table:
    """Step 1, in a bucket. ``place`` is first << 13 | owner << 7 | span << 1, plus
    0 for a repeat as a whole, 1 for a piece whose bytes have to be compared."""
    parts = [unpack_bucket(b.as_py()) for b in table.column("blob")]
    field = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
    parts.clear()
    prints = field.pop("high").astype(np.uint64) << np.uint64(32) | field.pop("low").astype(np.uint64) << np.uint64(16)
    prints |= field["key"].astype(np.uint64) & np.uint64(0xFFFF)
    order = np.argsort(prints, kind="stable")
    runs = starts_of(prints[order])
    sizes = np.diff(np.concatenate([runs, [len(order)]]))
    smallest = np.minimum.reduceat(field["id"][order], runs)
    own = np.empty(len(order), np.int64)
    own[order] = np.repeat(smallest, sizes)
    whole = field["id"] > own
    # wordings with the same owner, and the same bytes on one side of it, in
    # different documents
    one = order[runs]
    several = np.zeros(len(runs), bool)
    for side in ("left", "right"):
        key = field["key"][one].astype(np.int64) << 8 | field[side][one]
        by_key = np.argsort(key, kind="stable")
        groups = starts_of(key[by_key])
        low, high = (f.reduceat(smallest[by_key], groups) for f in (np.minimum, np.maximum))
        several[by_key] |= np.repeat(low < high, np.diff(np.concatenate([groups, [len(by_key)]])))
    open_ = np.zeros(len(order), bool)
    open_[order] = np.repeat(several, sizes)
    open_ &= ~whole
    keep = whole | open_
    place = field["first"].astype(np.int64) << 13 | field["owner"].astype(np.int64) << 7
    place |= field["span"].astype(np.int64) << 1 | open_
    return pa.table({"id": field["id"][keep], "tag": field["tag"][keep], "place": place[keep]})


def flat_lists(column: pa.Array, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column's rows first..last; null lists are empty."""
    part = column.slice(first, last - first)
    lengths = np.nan_to_num(pa.compute.list_value_length(part).to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    return np.repeat(np.arange(last - first), lengths), part.flatten().to_numpy(zero_copy_only=False)


def cut_out(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes data[start:start + size] of all rows end to end, and offsets."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return data[index], offsets


def send_bytes(buckets: int, length: int, seed: int):
    """Step 2, at the texts: the bytes of pieces to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        up, _ = table.upto(seed + 1)
        for batch in batches:
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            for low, high, data, offsets in text_slices(batch.column("text")):
                row, place = flat_lists(batch.column("places"), low, high)
                row, place = row[place & 1 == 1], place[place & 1 == 1]
                if not len(place):
                    continue
                first, owner, span = place >> 13, place >> 7 & 63, place >> 1 & 63
                at = offsets[row] + first
                taken, bounds = cut_out(data, at, span + length)
                grid = data[(at + owner)[:, None] + np.arange(seed)].astype(np.uint64) + np.uint64(1)
                key = mix((grid * up[:seed]).sum(axis=1, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((key % np.uint64(buckets)).astype(np.int32)),
                        pa.array(key.view(np.int64)),
                        pa.array(ids[low:high][row]),
                        pa.array(tags[low:high][row]),
                        pa.array(first),
                        pa.array(owner.astype(np.int32)),
                        pa.Array.from_buffers(
                            pa.binary(),
                            len(at),
                            [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(taken.tobytes())],
                        ),
                    ],
                    names=["bucket", "key", "id", "tag", "first", "owner", "bytes"],
                )

    return run


class Suffixes:
    """Suffixes of one text, compared in their first ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int) -> None:
        table = Powers()
        self.data, self.length = data, length
        self.prefix = prefix_hashes(data, table)
        self.down = table.upto(len(data) + 1)[1]

    def alike(self, a: np.ndarray, b: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Whether the first ``size`` bytes have the same hash."""
        left = (self.prefix[a + size] - self.prefix[a]) * self.down[a]
        return left == (self.prefix[b + size] - self.prefix[b]) * self.down[b]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension: the whole first, else binary search."""
        out = np.full(len(a), self.length)
        rest = np.flatnonzero(~self.alike(a, b, self.length))
        low, high = np.zeros(len(rest), np.int64), np.full(len(rest), self.length - 1)
        for _ in range(int(self.length).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.alike(a[rest], b[rest], middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out[rest] = low
        return out

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        size = self.extension(a, b)
        more = np.minimum(size, self.length - 1)
        return np.where(size == self.length, or_equal, self.data[a + more] < self.data[b + more])

    def sort(self, at: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Merge sort of each group's suffixes; ``groups`` gives where they begin.

        In a round every element looks up its rank in the run beside its own, all
        elements at once; groups that are one run already take no part.
        """
        at = at.copy()
        sizes = np.diff(np.concatenate([groups, [len(at)]]))
        begin, size = np.repeat(groups, sizes), np.repeat(sizes, sizes)
        active, width = np.flatnonzero(size > 1), 1
        while len(active):
            own = active - begin[active]
            run = own // width
            right = run & 1 == 1
            other = begin[active] + np.where(right, run - 1, run + 1) * width
            end = begin[active] + size[active]
            low = np.minimum(other, end)
            first, high = low.copy(), np.minimum(other + width, end)
            mine = at[active]
            while len(todo := np.flatnonzero(low < high)):
                middle = (low[todo] + high[todo]) >> 1
                # elements of the right run come after equal ones of the left run
                less = self.before(at[middle], mine[todo], right[todo])
                low[todo] = np.where(less, middle + 1, low[todo])
                high[todo] = np.where(less, high[todo], middle)
            target = begin[active] + (run >> 1) * 2 * width + (own - run * width) + (low - first)
            at[target] = mine
            width *= 2
            active = active[size[active] > width]
        return at


def equal_neighbours(text: Suffixes, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, whether each equals the one before it, whether all hashes were true)."""
    order = np.argsort(group, kind="stable")
    position, begins = at[order], starts_of(group[order])
    sorted_at = text.sort(position, begins)
    same = np.zeros(len(at), bool)
    if len(at) > 1:
        same[1:] = text.alike(sorted_at[:-1], sorted_at[1:], text.length)
    same[begins] = False
    pairs = np.flatnonzero(same)
    true = True
    for low in range(0, len(pairs), 1 << 16):
        some = pairs[low : low + (1 << 16), None]
        span = np.arange(text.length)
        true &= bool((text.data[sorted_at[some] + span] == text.data[sorted_at[some - 1] + span]).all())
    return sorted_at, same, np.bool_(true)


def shared_hashes(text: Suffixes, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The windows whose hash another one of their group has; the others are equal to none."""
    hashes = mix((text.prefix[at + text.length] - text.prefix[at]) * text.down[at] + mix(group.astype(np.uint64)))
    order = np.argsort(hashes)
    hashes = hashes[order]
    equal = hashes[1:] == hashes[:-1]
    shared = np.zeros(len(at), bool)
    shared[order[1:][equal]] = True
    shared[order[:-1][equal]] = True
    return np.flatnonzero(shared)


def compare_windows(length: int):
    """Step 2, in a bucket: windows that a smaller document has too, as byte ranges."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = table.column("bytes").combine_chunks() if table.num_rows else table.column("bytes")
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)
        ids = table.column("id").to_numpy()
        tags, firsts = table.column("tag").to_numpy(), table.column("first").to_numpy()
        windows = np.diff(offsets) - length + 1
        row = np.repeat(np.arange(len(ids)), windows)
        step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = offsets[row] + step
        # windows can only be equal if the owner is, at the same place in them
        keys = np.unique(table.column("key").to_numpy(), return_inverse=True)[1]
        group = keys[row] << 8 | (table.column("owner").to_numpy()[row] - step + 64)
        text = Suffixes(data, length)
        some = shared_hashes(text, at, group)
        sorted_at, same, true = equal_neighbours(text, at[some], group[some])
        back = np.empty(len(data), np.int64)
        back[at] = np.arange(len(at))
        if true:
            order = back[sorted_at]
        else:
            view = np.lib.stride_tricks.sliding_window_view(data, length)[at[some]]
            order = np.lexsort([*view.T[::-1], group[some]])
            same = np.concatenate([[False], (view[order[1:]] == view[order[:-1]]).all(axis=1)])
            order = some[order]
            same[1:] &= group[order[1:]] == group[order[:-1]]
        runs = np.flatnonzero(~same)
        smallest = np.minimum.reduceat(ids[row[order]], runs) if len(runs) else ids[:0]
        repeat = np.zeros(len(at), bool)
        repeat[order] = ids[row[order]] > np.repeat(smallest, np.diff(np.concatenate([runs, [len(order)]])))
        hit = np.flatnonzero(repeat)
        fresh = np.concatenate([[True], (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]])]) if len(hit) else hit > 0
        begin, end = hit[fresh], hit[np.concatenate([fresh[1:], [True]])] if len(hit) else hit
        place = firsts[row[begin]] + step[begin]
        stop = firsts[row[end]] + step[end] + length
        return pa.table({"id": ids[row[begin]], "tag": tags[row[begin]], "start": place, "stop": stop})

    return run


def remove(columns: list[str], length: int, characters: bool):
    """Step 3: drops covered bytes; the other columns come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("text")):
                row, place = flat_lists(batch.column("places"), low, high)
                row, place = row[place & 1 == 0], place[place & 1 == 0]
                start, stop = offsets[row] + (place >> 13), offsets[row] + (place >> 13) + (place >> 1 & 63) + length
                row, begin = flat_lists(batch.column("starts"), low, high)
                end = flat_lists(batch.column("stops"), low, high)[1]
                depth = np.zeros(len(data) + 1, np.int64)
                np.add.at(depth, np.concatenate([start, offsets[row] + begin]), 1)
                np.add.at(depth, np.concatenate([stop, offsets[row] + end]), -1)
                gone = np.cumsum(depth[:-1]) > 0
                if characters and len(data):
                    lead = np.flatnonzero((data & 0xC0) != 0x80)
                    size = np.diff(np.concatenate([lead, [len(data)]]))
                    gone = np.repeat(np.logical_and.reduceat(gone, lead), size)
                upto = np.concatenate([[0], np.cumsum(gone)])[offsets]
                edge = np.zeros(len(data) + 1, bool)
                edge[offsets] = True
                opens = gone.copy()
                opens[1:] &= ~gone[:-1] | edge[1:-1]
                spans = np.concatenate([[0], np.cumsum(opens)])[offsets]
                sizes = np.diff(offsets)
                removed = np.diff(upto)
                left = np.concatenate([[0], np.cumsum(sizes - removed)]).astype(np.int32)
                kept = pa.Array.from_buffers(
                    pa.string() if characters else pa.binary(), high - low, [None, pa.py_buffer(left.tobytes()), pa.py_buffer(data[~gone].tobytes())]
                )
                own = [batch.column(c).slice(low, high - low) for c in columns]
                counts = [pa.array(x.astype(np.int64)) for x in (sizes, removed, np.diff(spans))]
                yield pa.RecordBatch.from_arrays([*own, kept, *counts], names=[*columns, *RESULTS])

    return run


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED, characters: bool = False
) -> DataFrame:
    """The columns of ``docs``, kept (binary: the bytes that stay), n_bytes,
    n_removed and n_spans (maximal runs removed).

    With ``characters``, kept is text: a character goes if all its bytes do.
    """
    if not 8 <= seed <= length <= seed + 62:
        raise ValueError("a window may be at most 62 bytes longer than its seed, of 8 or more")
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in docs.columns if c not in RESULTS]
    inner = ["text" if c == "text" else f"own_{i}" for i, c in enumerate(columns)]
    rows = docs.select(
        *[F.col(f"`{c}`").cast("string").alias(k) if c == "text" else F.col(f"`{c}`").alias(k) for c, k in zip(columns, inner, strict=True)],
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"),
    ).withColumn("tag", F.xxhash64("text"))

    entries = rows.select("id", "tag", "text").mapInArrow(announce(buckets, length, seed), "bucket int, blob binary")
    found = entries.groupBy("bucket").applyInArrow(compare_pieces, "id long, tag long, place long")
    places = materialize(found.groupBy("id", "tag").agg(F.collect_list("place").alias("places")))
    placed = rows.join(places, ["id", "tag"], "left")

    pieces = placed.mapInArrow(
        send_bytes(8 * buckets, length, seed),
        "bucket int, key long, id long, tag long, first long, owner int, bytes binary",
    )
    ranges = pieces.groupBy("bucket").applyInArrow(compare_windows(length), "id long, tag long, start long, stop long")
    ranges = ranges.groupBy("id", "tag").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")
    )
    whole = placed.join(ranges, ["id", "tag"], "left")
    schema = T.StructType(
        [T.StructField(k, rows.schema[k].dataType) for k in inner]
        + [T.StructField("kept", T.StringType() if characters else T.BinaryType())]
        + [T.StructField(k, T.LongType()) for k in RESULTS[1:]]
    )
    return whole.mapInArrow(remove(inner, length, characters), schema).toDF(*columns, *RESULTS)
