"""Session helpers, shared intermediate tables and vectorised text hashing.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, which is what
``bytes.split()`` gives.  A null ``doc_id`` sorts after every other id.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.plans.ship import ship
from cohortframe.plans.tables import drop, materialize, shared_dir

__all__ = ["drop", "materialize", "shared_dir", "ship"]

#: Stands for a null doc_id inside packed arrays: larger than every other id.
NULL_ID = (1 << 63) - 1


def give_back() -> None:
    """Free memory of a Python worker goes back to the system, at the end of a task that held large arrays.

    A worker lives on for the next task, and its allocators keep what they once had.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def doc_key():
    """``doc_id`` as a non-null long; null becomes :data:`NULL_ID`."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def real_id(col: str = "doc_id"):
    """The inverse of :func:`doc_key`."""
    return F.when(F.col(col) != NULL_ID, F.col(col))


def bucketed(docs: DataFrame, least: int = 4 << 20, most: int = 64 << 20) -> tuple[DataFrame, int]:
    """(doc_id, text bytes, bucket), hash buckets of even size, and how many there are.

    The buckets depend on ``doc_id`` and the corpus size only, so every pass over
    the same table makes the same ones.  Rows that buckets send to as many key ranges hold
    (bucket bytes)**2 / (6.4 * corpus bytes) words, so buckets grow with the root of the corpus.
    """
    ship(docs.sparkSession)
    total = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // min(most, max(least, int((400 * total) ** 0.5)))))
    key = doc_key()
    return docs.select(
        key.alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        F.pmod(F.xxhash64(key, F.lit(7)), F.lit(n)).cast("int").alias("bucket"),
    ), n


# --- hashing -----------------------------------------------------------------------

_M = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multipliers; their inverses modulo 2**64 make prefix sums into window hashes.
_BYTE = 0x9E3779B97F4A7C15
_WORD = 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i below ``n`` or more."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = _powers[base] = tuple(made)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_hashes(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """A 64-bit hash of every window of ``size`` consecutive values."""
    n = len(values)
    if n < size:
        return np.empty(0, np.uint64)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.multiply(values, up[:n], out=total[1:])
    np.add.accumulate(total, out=total)
    h = total[size:] - total[: n - size + 1]
    h *= down[: n - size + 1]
    return mix(h)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of ``text``, in order, and where each starts."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = powers(_BYTE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.multiply(data.astype(np.uint64) + np.uint64(1), up[: len(data)], out=total[1:])
    np.add.accumulate(total, out=total)
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64)), start


def groups_of(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(sorted_values):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def slices(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(start, end) of each run of :func:`groups_of` among ``n`` values."""
    return list(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True)) if len(starts) else []


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of 64-bit keys each key lies in."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


# --- windows and suffixes ------------------------------------------------------------------


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each ``span`` consecutive values stands; of equal ones the first."""
    at, low, width = np.arange(len(values)), values, 1

    def merge(by: int) -> None:
        nonlocal at, low
        right = low[by:] < low[:-by]
        at, low = np.where(right, at[by:], at[:-by]), np.where(right, low[by:], low[:-by])

    if len(values) < span:
        return at[:0]
    while 2 * width <= span:
        merge(width)
        width *= 2
    if width < span:
        merge(span - width)
    return at


def _dense(key: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones, from 1."""
    order = np.argsort(key)
    rank = np.empty(len(key), np.uint64)
    s = key[order]
    rank[order] = np.cumsum(np.concatenate(([True], s[1:] != s[:-1]))[: len(s)]).astype(np.uint64)
    return rank


def depth_ranks(values: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each place's next ``depth`` values (fewer at the end), by prefix doubling; values are 1 or more.

    Values below 256 are packed seven to a key first.
    """
    n, have = len(values), 1
    small = n > 0 and int(values.max()) <= 256
    if small:
        have = min(depth, 7)
        data = np.concatenate((values, np.zeros(7, np.uint64)))
        key = np.zeros(n, np.uint64)
        for i in range(have):
            key = key * np.uint64(257) + data[i : i + n]
        rank = _dense(key)
    else:
        rank = _dense(values)
    while have < depth:
        step = min(have, depth - have)
        ahead = np.zeros(n, np.uint64)
        if step < n:
            ahead[: n - step] = rank[step:]
        rank = _dense((rank << np.uint64(32)) | ahead)
        have += step
    return rank
