"""Helpers that several corpus operators share: lineage cuts in the shared
folder, bounded batching of Arrow rows and vectorised word hashing."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrolens.lineage import cut, shared_dir

__all__ = ["CHUNK_BYTES", "byte_words", "chunks", "cut", "few", "look_up", "mix", "release", "row_id", "shared_dir", "span_hashes"]

#: A key is hot if it holds more than one row in so many; so there are fewer hot keys than this.
HOT_KEYS = 10_000
#: Rows of keys and numbers that may be broadcast, by count (some 20 MB at most).
FEW_ROWS = 1 << 18

#: Bytes of text that one numpy chunk holds at most, a longer document alone excepted.
CHUNK_BYTES = 1 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # not glibc
    _LIBC = None

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def release() -> None:
    """Give freed memory back to the system, which an allocator else keeps: large
    arrays come and go, and a worker's next stage may need none."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def row_id(key: str | Column) -> Column:
    """An id as a long. One that is no integer counts as null."""
    return (F.col(key) if isinstance(key, str) else key).try_cast("long")


def few(keys: DataFrame) -> DataFrame:
    """``keys``, materialised and of short rows, to be broadcast if they have been
    counted and are few."""
    return F.broadcast(keys) if keys.count() <= FEW_ROWS else keys


def look_up(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` (``total`` of them) with ``table``, materialised, one
    short row a key, whose column ``n`` counts the rows of the key. A table that
    has been counted and is small is broadcast. Else rows of hot keys meet it
    where they lie: fewer than HOT_KEYS keys hold more than one row in HOT_KEYS,
    so those are broadcast; the others are joined by a shuffle."""
    if table.count() <= FEW_ROWS:
        return rows.join(F.broadcast(table), on)
    hot = table.where(F.col(n) > total // HOT_KEYS + 1)
    rest = table.where(F.col(n) <= total // HOT_KEYS + 1)
    lone = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(lone.join(rest, on))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd 64-bit base and of its inverse modulo 2**64."""
    base, inverse = int(_MULT), pow(int(_MULT), -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of values[starts[i]:ends[i]], all at once.

    ``values``: uint64, one well-mixed number a symbol. Equal spans have equal
    hashes wherever they stand; the length enters the last mix."""
    n = len(values)
    size = 1 << max(20, (max(n, 1) - 1).bit_length())
    up, down = _powers(size)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _MIX_A)


def chunks(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs whose sizes sum to ``limit`` at most (one row at least)."""
    at, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > limit:
            yield at, i
            at, total = i, 0
        total += int(s)
    if at < len(sizes):
        yield at, len(sizes)


# Bytes \x09-\x0D and \x20 part words in the byte view; A-Z become a-z.
BYTE_SPACE = np.zeros(256, bool)
BYTE_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_LOWER = np.arange(256, dtype=np.uint8)
BYTE_LOWER[0x41:0x5B] += 32
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)[BYTE_LOWER]


def byte_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie end to end in ``data`` (uint8); bounds: n+1 offsets.

    Returns word starts, word ends and the number of words before each bound.
    A word never crosses a bound."""
    inside = ~BYTE_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] |= inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] |= inside[before]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds, "left")
