"""Vectorised work on the UTF-8 bytes of many texts at once.

Everything here handles one slice of an Arrow batch: the texts' bytes laid end
to end, and the offsets where each begins. Nulls count as empty texts. Slices
hold about a megabyte, or one text that is longer, so memory follows the longest
text and never the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and one offset more than it has rows."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    rows = len(column)
    if rows == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, count=rows + 1, offset=8 * column.offset)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text has one of its own."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = byte_column(column)
    for first, last in slices(offsets):
        own = offsets[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


#: [^\x20\x09-\x0D]+ and, after lower-casing, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
VISIBLE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = lower_table()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    table = np.full(n, base, np.uint64)
    if n:
        table[0] = 1
    return np.cumprod(table, dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse, as far as asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
            self.up, self.down = powers(BASE, size), powers(INVERSE, size)
        return self.up, self.down


def prefix_hashes(data: np.ndarray, table: Powers) -> np.ndarray:
    """Prefix polynomials: the hash of data[i:j] is (p[j] - p[i]) / BASE**i."""
    up, _ = table.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


class Words:
    """The words of a slice: where they start and end, whose they are, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, table: Powers) -> None:
        n = len(data)
        mask = inside[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = mask[:-1]
        after = np.zeros(n, bool)
        after[:-1] = mask[1:]
        self.start = np.flatnonzero(mask & (~before | edge[:-1]))
        self.end = np.flatnonzero(mask & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        prefix = prefix_hashes(data, table)
        _, down = table.upto(n + 1)
        self.hash = mix((prefix[self.end] - prefix[self.start]) * down[self.start])
        #: words of row r are first[r]:first[r + 1]
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))

    def grams(self, mask: str) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all runs of words as long as ``mask``, within one row,
        and the hash of the words where the mask has a 1."""
        at = np.arange(max(0, len(self.hash) - len(mask) + 1))
        if len(at):
            at = at[self.doc[at] == self.doc[at + len(mask) - 1]]
        total = np.full(len(at), len(mask), np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                total = mix(total * np.uint64(BASE) + self.hash[at + j])
        return at, total


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One list per row out of all rows' values laid end to end."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))
