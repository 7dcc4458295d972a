"""Vectorised byte and word kernels over Arrow string columns.

Texts are handled in blocks of about :data:`BLOCK` bytes, so the arrays made
here stay small however many rows an Arrow batch has.  Words are maximal runs
of bytes other than space and 0x09-0x0D, which on UTF-8 is the same as the
pattern ``[^\\x20\\x09-\\x0D]+`` on characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled at once; one longer text is handled alone.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    n = len(col)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, n + 1 + col.offset)[col.offset :].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return bytes_, offsets


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``size`` bytes together, or one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def bound_batches(df: DataFrame, mb: int = 4) -> None:
    """Let Arrow batches hold at most ``mb`` megabytes, unless the session has its own bound.

    Spark's default is 64 MB, which a task holds several times over: while the
    vectors grow, on their way to Python, and there.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("64MB", "67108864b", "67108864"):
        conf.set(key, f"{mb}m")


def trim() -> None:
    """Give memory that is free again back to the system, so that workers stay small between batches."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2**64, and of its inverse."""
    got = _pow.get(base)
    if got is None or len(got[0]) <= n:
        m = max(n + 1, (1 << 18) + 64)
        up = np.full(m, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        up[0] = 1
        down = np.full(m, pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if m <= 4 * BLOCK:
            _pow[base] = got
    return got


def rolling(values: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of all runs of ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers(n, base)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[width:] - total[: n - width + 1]) * down[: n - width + 1])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a block, and where each text's words start among them.

    ``offsets`` are the texts' bounds inside ``data``.
    """
    is_word = _IS_WORD[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` folds A-Z."""
    base = (_BASE + 2 * seed * 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF | 1
    up, down = powers(len(data), base)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where a new (first, second) pair starts in sorted arrays."""
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return np.flatnonzero(new)


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """A list column of numpy values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
