"""NumPy kernels over Arrow string columns: words, lines, hashes, shingles.

All functions work on the UTF-8 bytes of a whole Arrow batch, so a task spends
its time in vectorised code and not in per-word Python.  Separators are ASCII,
and no byte of a longer UTF-8 sequence is ASCII, so cutting bytes cuts text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
# Odd multipliers of the finaliser (splitmix64).
BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

#: Bytes of text that are hashed in one vectorised step; bounds the temporaries.
PIECE = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + U64((salt * BASE + BASE) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(30)
    x *= U64(MIX_1)
    x ^= x >> U64(27)
    x *= U64(MIX_2)
    x ^= x >> U64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[0x0A] = True

#: Runs of more bytes are hashed one by one by the library.
LONG_RUN = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes.

    Eight bytes at a time go through a finaliser, so the hash isn't linear in the
    bytes and no family of texts collides by construction.
    """
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    out = mix(size.astype(U64), 3)
    long = np.flatnonzero(size > LONG_RUN)
    at, left, open_ = start, size, None  # the first step has every run
    if len(long):
        open_ = np.flatnonzero(size <= LONG_RUN)
        at, left = start[open_], size[open_]
    while len(at):
        block = eight[at] & _MASKS[np.minimum(left, 8)]
        if open_ is None:
            out = mix(out * U64(MIX_1) ^ block)
            more = np.flatnonzero(left > 8)
            open_ = more
        else:
            out[open_] = mix(out[open_] * U64(MIX_1) ^ block)
            more = np.flatnonzero(left > 8)
            open_ = open_[more]
        at, left = at[more] + 8, left[more] - 8
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, lower: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are no separators, cut at document borders.

    Returns (start, end, hash, first): byte positions, a 64-bit hash of each
    run's bytes (A-Z as a-z if ``lower``), and for each document the index of
    its first run (one entry more than there are documents).
    """
    starts, ends, hashes = [], [], []
    at, size = 0, len(data)
    while at < size:
        to = min(size, at + PIECE)
        while to < size and not separators[data[to]]:  # a run is never cut
            more = np.flatnonzero(separators[data[to : to + PIECE]])
            to += int(more[0]) if len(more) else PIECE
        to = min(to, size)
        piece = data[at:to]
        word = ~separators[piece]
        border = np.zeros(len(piece) + 1, dtype=bool)
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        border[inside] = True
        border[0] = border[-1] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | border[1:-1]
        stop = word.copy()
        stop[:-1] &= ~word[1:] | border[1:-1]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        if len(s):
            hashes.append(hash_runs(LOWER[piece] if lower else piece, s, e))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    empty = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else empty
    end = np.concatenate(ends) if ends else empty
    hashed = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    return start, end, hashed, np.searchsorted(start, offsets)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words, in order; fewer words make one window."""
    n = len(words)
    if n == 0:
        return words
    length = min(n, width)
    out = np.full(n - length + 1, length, U64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = mix(out * U64(MIX_1) + words[k : n - length + 1 + k], k)
    return out


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0))
        group = np.cumsum(lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
