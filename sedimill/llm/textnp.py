"""Vectorised text work on Arrow string columns: bytes, words, shingles."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240607)
#: One random 64-bit value for each byte, with A-Z mapped to a-z in the second table.
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = BYTE_CODES[97:123]
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 2**64))
_STEP = U64(0xD6E8FEB86659FD93)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text handled at once; one longer document is handled alone.
BLOCK = 1_000_000
#: What empties the tables that a step's tasks leave in their worker for its later tasks.
REMEMBERED: list[Callable[[], None]] = []


def tuned(spark) -> None:
    """Smaller Arrow batches than the default of 10,000 rows, which whole documents would make too large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(data: np.ndarray, at: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``limit`` bytes: first, end, bytes, offsets."""
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    kept = _powers[0][:n], _powers[1][:n]
    if n > 8 * BLOCK:  # a giant document's tables aren't kept
        _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
    return kept


def spare() -> None:
    """Give back the tables of powers and what the allocators hold of freed memory."""
    _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run: Callable, forget: bool = True) -> Callable:
    """``run``, for mapInArrow, with what it no longer needs given back at the task's end, as workers live on beside the tasks of other steps; ``forget``: what other steps remember goes before it."""

    def whole(batches):
        if forget:
            for empty in REMEMBERED:
                empty()
        try:
            yield from run(batches)
        finally:
            spare()

    return whole


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the block, and the number of words of each document."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    word = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(word[:-1], out=before[1:])
    starts = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(word[1:], out=after[:-1])
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, at))


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = LOWER_CODES) -> np.ndarray:
    """A 64-bit code of each word; with LOWER_CODES, A-Z count as a-z."""
    p, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(codes[data] * p[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * _STEP)


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of each document's k-word shingles, and n+1 offsets into them.

    A document of fewer than k words has its whole sequence as one shingle, one without words none.
    """
    starts, ends, count = words(data, at)
    code = word_codes(data, starts, ends)
    first = np.concatenate([[0], np.cumsum(count)])
    own = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(own)])
    out = np.empty(out_at[-1], U64)
    long = count >= k
    if len(code) >= k:
        x = code[: len(code) - k + 1].copy()
        for j in range(1, k):
            x = mix(x * _STEP + code[j : len(code) - k + 1 + j])
        keep = np.ones(len(x), bool)
        for j in range(1, k):  # a shingle ends in its own document
            stop = first[1:] - j
            stop = stop[(stop >= 0) & (stop < len(x))]
            keep[stop] = False
        fill = np.repeat(long, own)
        out[fill] = x[keep]
    short = np.flatnonzero(~long & (count > 0))
    if len(short):
        x = code[first[short]]
        for j in range(1, k):
            m = count[short] > j
            x[m] = mix(x[m] * _STEP + code[first[short[m]] + j])
        out[out_at[short]] = mix(x + count[short].astype(U64) * _BASE)
    for a, b in zip(out_at[:-1], out_at[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    if len(out):
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[out_at[:-1][own > 0]] = True
        own = np.add.reduceat(new.astype(np.int64), out_at[:-1][own > 0])
        sizes = np.zeros(len(at) - 1, np.int64)
        sizes[count > 0] = own
        out = out[new]
        out_at = np.concatenate([[0], np.cumsum(sizes)])
    return out, out_at
