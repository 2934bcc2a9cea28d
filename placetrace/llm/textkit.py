"""Byte-level helpers for Arrow batches of texts: words, hashes and counts in numpy.

A null text counts as an empty one.  All functions take whole texts; a batch is
worked through in pieces of about ``PIECE`` bytes, and a longer text is a piece
of its own, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15


def text_buffer(column):
    """Bytes and offsets of a string or binary Arrow column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def pieces(column, size=PIECE):
    """(first row, last row, bytes, offsets from 0) for runs of rows of about ``size`` bytes."""
    data, offsets = text_buffer(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        stop = min(stop, n, at + 4096)
        yield at, stop, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def mix(x):
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(lower=False):
    """A 64-bit number for each byte; with ``lower``, A-Z share those of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def power_tables(n):
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i up to n."""
    up = np.full(n + 1, BASE, np.uint64)
    down = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def separators():
    """True for the bytes 0x20 and 0x09-0x0D."""
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def word_spans(data, offsets, apart):
    """Starts, ends and rows of the runs of bytes outside ``apart``; rows end words."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~apart[data]
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, ends, rows


class Hasher:
    """Polynomial hashes of any spans of a piece, from one running sum."""

    def __init__(self, lower=False):
        self.codes = byte_codes(lower)
        self.up, self.down = power_tables(PIECE)

    def running(self, data):
        if len(data) >= len(self.up):
            self.up, self.down = power_tables(len(data) * 2)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[: len(data)], out=total[1:])
        return total

    def spans(self, total, starts, ends):
        return mix((total[ends] - total[starts]) * self.down[starts])


def word_runs(hashes, rows, n):
    """Hash of each run of ``n`` words of one row, and its row; see ``short_rows`` for the rest."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out = (out + hashes[j : j + count]) * np.uint64(BASE)
    whole = rows[:count] == rows[n - 1 :]
    return mix(out[whole]), rows[:count][whole]


def shingle_sets(data, offsets, n, hasher, apart):
    """Per row the sorted distinct hashes of its n-word shingles.

    A row with fewer words has one, of its whole sequence; without words, none.
    """
    starts, ends, rows = word_spans(data, offsets, apart)
    hashes = hasher.spans(hasher.running(data), starts, ends)
    runs, of = word_runs(hashes, rows, n)
    row_ids = np.arange(len(offsets) - 1)
    first, last = np.searchsorted(of, row_ids), np.searchsorted(of, row_ids, "right")
    word_first, word_last = np.searchsorted(rows, row_ids), np.searchsorted(rows, row_ids, "right")
    sets = []
    for r in range(len(row_ids)):
        if last[r] > first[r]:
            x = np.sort(runs[first[r] : last[r]])
            sets.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        else:
            words = hashes[word_first[r] : word_last[r]]
            total = np.uint64(0)
            with np.errstate(over="ignore"):
                for h in words:
                    total = (total + h) * np.uint64(BASE)
            sets.append(mix(np.array([total ^ np.uint64(len(words))])) if len(words) else np.zeros(0, np.uint64))
    return sets


def row_sums(values, offsets):
    """Sums of ``values`` between neighbouring offsets; 0 for empty rows."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
