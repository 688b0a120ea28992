"""Which keys occur in two places of a corpus, asked in compact form.

Every bucket of documents sends each of its distinct keys once, five bytes with two flags, to the
range of keys that it falls in; the range answers with those that repeat.  A key that
a third of all documents share is thus one entry per bucket.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortframe.llm.common import groups_of, is_in, part_of, slices

#: Bits of a key that travel besides its range.
_REST = np.uint64((1 << 38) - 1)
SCHEMA = "part int, bucket int, keys binary"
#: Segments of texts on their way to a range of keys.
SEGMENT = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("ids", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary()), ("text", pa.binary())])
SEGMENT_SQL = "part int, bucket int, ids binary, docs binary, starts binary, counts binary, text binary"


class Bucket:
    """The documents of one bucket in order of (doc_id, text); equal rows are separate documents."""

    def __init__(self, table: pa.Table) -> None:
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.texts: list[bytes] = [texts[i] for i in order]

    def chunks(self, size: int):
        """(first document, end) of runs of documents of about ``size`` bytes."""
        at = n = 0
        for i, t in enumerate(self.texts):
            n += len(t)
            if n >= size or i == len(self.texts) - 1:
                yield at, i + 1
                at, n = i + 1, 0


def pack(values: np.ndarray) -> bytes:
    """Five bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = len(data) // 5
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(n, 5)
    return out.view("<u8").ravel()


def by_part(keys: np.ndarray, parts: int) -> list[tuple[int, slice]]:
    """(part, slice) for sorted keys."""
    part = part_of(keys, parts)
    return [(int(part[a]), slice(a, z)) for a, z in slices(groups_of(part), len(keys))]


def send(bucket: int, keys: np.ndarray, multi: np.ndarray, sure: np.ndarray, parts: int) -> pa.Table:
    """Rows for distinct sorted keys. multi: it is in two places here; sure: it may be a reference."""
    rest = ((keys & _REST) << np.uint64(2)) | multi.astype(np.uint64) | (sure.astype(np.uint64) << np.uint64(1))
    rows = [(p, bucket, pack(rest[s])) for p, s in by_part(keys, parts)]
    return table(rows)


def table(rows: list[tuple]) -> pa.Table:
    part, bucket, keys = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"part": pa.array(part, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "keys": pa.array(keys, pa.binary())})


def answer(crowded: int) -> Callable[[pa.Table], pa.Table]:
    """Of one range: which keys to tell which bucket.  The lowest bit tells keys of more than ``crowded`` buckets."""

    def run(t: pa.Table) -> pa.Table:
        part, bucket = t.column("part")[0].as_py(), t.column("bucket").to_numpy()
        lists = [unpack(x) for x in t.column("keys").to_pylist()]
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        rest = np.concatenate(lists)
        order = np.argsort(rest >> np.uint64(2), kind="stable")
        key, flag = rest[order] >> np.uint64(2), rest[order] & np.uint64(3)
        start = groups_of(key)
        n = np.diff(np.append(start, len(key)))
        flags = np.bitwise_or.reduceat(flag, start)
        found = ((n > 1) | (flags & np.uint64(1) > 0)) & (flags & np.uint64(2) > 0)
        keep = np.repeat(found, n)
        told = ((key << np.uint64(1)) | np.repeat(n > crowded, n).astype(np.uint64))[keep]
        to = row[order][keep]
        by = np.argsort(to, kind="stable")
        told, to = told[by], to[by]
        return table([(part, int(bucket[to[a]]), pack(told[a:z])) for a, z in slices(groups_of(to), len(to))])

    return run


def repeated(sent: DataFrame, crowded: int = 1 << 30) -> DataFrame:
    """(part, bucket, keys): what :func:`answer` tells each bucket."""
    return sent.groupBy("part").applyInArrow(answer(crowded), SCHEMA)


class Told:
    """The repeated keys a bucket was told of."""

    def __init__(self, parts: list[int], keys: list[bytes], n_parts: int) -> None:
        self.n = n_parts
        each = [(np.uint64(p) << np.uint64(39)) | unpack(k) for p, k in zip(parts, keys, strict=True)]
        every = np.sort(np.concatenate(each)) if each else np.empty(0, np.uint64)
        self.keys, crowded = every >> np.uint64(1), every & np.uint64(1)
        self.crowded = self.keys[crowded > 0]

    def _short(self, keys: np.ndarray) -> np.ndarray:
        return (part_of(keys, self.n).astype(np.uint64) << np.uint64(38)) | (keys & _REST)

    def repeats(self, keys: np.ndarray) -> np.ndarray:
        return is_in(self._short(keys), self.keys)

    def is_crowded(self, keys: np.ndarray) -> np.ndarray:
        return is_in(self._short(keys), self.crowded)
