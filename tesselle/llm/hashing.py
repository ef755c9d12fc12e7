"""Vectorised word and substring hashes over Arrow text columns.

A column's UTF-8 bytes lie in one buffer; numpy passes over it find the words and hash any
substring from two prefix sums, with no Python loop over rows or words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one vectorised pass holds arrays for (a longer single text stands alone).
PASS_BYTES = 1 << 18
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_fold = np.arange(256)
_fold[65:91] += 32
#: As BYTE, with A-Z taken as a-z.
FOLDED = BYTE[_fold]
LOWER = _fold.astype(np.uint8)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) <= n:
        size = 1 << (n + 1).bit_length()
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and each row's bounds in them; a null counts as an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def passes(batch: pa.RecordBatch, column: str = "text", most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes of text."""
    bounds = text_bytes(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(function: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function of batches that gives its freed memory back to the system when a task ends, as workers live on."""

    @wraps(function)
    def inner(*args, **kwargs):
        try:
            yield from function(*args, **kwargs)
        finally:
            for key in _powers:
                _powers[key] = _powers[key][:1].copy()
            trim()

    return inner


def prefix(data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Prefix sums from which :func:`between` hashes any substring."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(table[data] * up[: len(data)], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end)."""
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start])


def words(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes in ``member``, which end with their row, and their rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = member[data]
    full = bounds[:-1] < bounds[1:]
    before = np.concatenate(([False], inside[:-1]))
    before[bounds[:-1][full]] = False
    after = np.concatenate((inside[1:], [False]))
    after[bounds[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(bounds, starts, "right") - 1


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the n consecutive words that begin at each word, where the row has as many."""
    if len(hashes) < n:
        return hashes[:0], rows[:0]
    m = len(hashes) - n + 1
    total = np.zeros(m, U)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * U(_BASE) + hashes[k : k + m]
    keep = rows[:m] == rows[n - 1 :]
    return mix(total[keep] + U(n)), rows[:m][keep]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
