"""Vectorised kernels over Arrow string columns.

A batch of texts is seen as one byte array plus offsets, straight from the
Arrow buffers, so no Python string is made per row. All kernels work on bounded
slices (``slices``); a single text larger than the bound is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once: the 64-bit arrays over them stay in the cache, and are too small to be mapped anew each time.
SLICE_BYTES = 100_000

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        upto = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        upto = min(max(upto, row + 1), rows)
        yield row, upto
        row = upto


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_values(seed: int) -> np.ndarray:
    """One random 64-bit value for each byte value."""
    return mix((np.arange(256, dtype=U64) + U64(1)) * U64(0xD6E8FEB86659FD93) + U64(seed))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(2 * n, 1 << 17)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            run = np.full(size, base, U64)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=U64)
    return _powers[0], _powers[1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Cumulative polynomial sums: the hash of [i, j) is (c[j] - c[i]) * inverse[i]."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], dtype=U64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def ascii_lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = ascii_lower_table()


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that do not cross texts."""
    inside = is_word[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
