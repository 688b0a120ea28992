"""Packing documents into token windows by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import give_back
from cohortframe.llm.tokenfile import CHUNK, pieces_of
from cohortframe.plans.ship import ship

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PIECE_SQL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: (doc_id, ids before it in its document, its ids, ids of the document)
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Windows of one stream of documents.

    A document goes to the fill level that makes the sum of the squared numbers of windows at each level below full
    least; of equally good levels to the fullest, and to a new window only where that is better.  ``count`` is that level array.
    """

    def __init__(self, window: int) -> None:
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.full: list[list[Piece]] = []

    def level(self, size: int) -> int:
        """The level to place ``size`` ids at; 0 is a new window."""
        w, count = self.window, self.count
        levels = np.flatnonzero(count[1 : w - size + 1]) + 1
        # squares change by 2n + 1 where a window arrives and by 1 - 2n where it leaves; full windows do not count
        arrive = np.where(levels + size < w, 2 * count[levels + size] + 1, 0)
        change = np.append((arrive + 1 - 2 * count[levels])[::-1], 2 * count[size] + 1 if size < w else 0)
        best = int(np.argmin(change))
        return int(levels[len(levels) - 1 - best]) if best < len(levels) else 0

    def place(self, piece: Piece) -> None:
        size = len(piece[2])
        at = self.level(size)
        pieces = [piece]
        if at:
            own = self.open[at]
            pieces = own.pop() + pieces
            self.count[at] -= 1
            if not own:
                del self.open[at]
        if at + size == self.window:
            self.full.append(pieces)
        else:
            self.count[at + size] += 1
            self.open.setdefault(at + size, []).append(pieces)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """A document: whole windows of it are full at once, the rest is placed."""
        n, w = len(ids), self.window
        for at in range(0, n - n % w, w):
            self.full.append([(doc_id, at, ids[at : at + w], n)])
        if n % w:
            self.place((doc_id, n - n % w, ids[n - n % w :], n))

    def taken(self) -> list[list[Piece]]:
        """Windows that have become full since the last call."""
        out, self.full = self.full, []
        return out

    def finish(self) -> list[list[Piece]]:
        """The windows still open: the emptiest fill up the fullest, the last one falls into windows of powers of two."""
        rest = [p for level in sorted(self.open, reverse=True) for p in self.open[level]]
        first, last, out = 0, len(rest) - 1, []
        while first < last:
            gap = self.window - _size(rest[first])
            while gap and first < last:
                doc_id, start, ids, n = rest[last].pop()
                keep = max(0, len(ids) - gap)
                rest[first].append((doc_id, start + keep, ids[keep:], n))
                gap -= len(ids) - keep
                if keep:
                    rest[last].append((doc_id, start, ids[:keep], n))
                if not rest[last]:
                    last -= 1
            if gap:
                break
            out.append(rest[first])
            first += 1
        if first == last:
            out.extend(_powers(rest[first]))
        self.count[:], self.open = 0, {}
        return out


def _size(pieces: list[Piece]) -> int:
    return sum(len(p[2]) for p in pieces)


def _powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in turn, cut into windows of falling powers of two."""
    left, out, queue = _size(pieces), [], pieces[::-1]
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        own: list[Piece] = []
        while want:
            doc_id, start, ids, n = queue.pop()
            own.append((doc_id, start, ids[:want], n))
            if len(ids) > want:
                queue.append((doc_id, start + want, ids[want:], n))
            want -= len(own[-1][2])
        out.append(own)
    return out


def _rows(windows: list[list[Piece]], first: int) -> pa.RecordBatch:
    flat = [(k, p) for k, w in enumerate(windows) for p in w]
    length = np.array([len(p[2]) for _, p in flat], np.int64)
    key = np.array([k for k, _ in flat], np.int64)
    before = np.cumsum(length) - length
    offset = before - before[np.searchsorted(key, key)]
    return pa.RecordBatch.from_arrays([
        pa.array([p[0] for _, p in flat], pa.int64()), pa.array([p[1] for _, p in flat], pa.int64()), pa.array(length), pa.array([p[2].tobytes() for _, p in flat], pa.binary()),
        pa.array([p[3] for _, p in flat], pa.int64()), pa.array(first + key), pa.array(offset),
    ], schema=_PIECE)


def pack_documents(docs: DataFrame, vocabulary_file: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), a row per piece of a document in a window.

    Every whole text is encoded, ``end_id`` appended, and placed in windows of ``window`` ids; ``ids`` holds the piece's ids as
    little-endian unsigned 32-bit integers.  Each task packs the documents it reads, as a stream, without a shuffle; it holds only the
    windows that are not full.  A document longer than a window first fills windows of its own.  What is open when the stream ends
    is cut: the emptiest windows fill up the fullest, and the last one becomes windows of powers of two, so nothing needs padding.

    Null texts are empty and give the end id alone; repeated rows are packed each; a null doc_id stays; other columns are
    ignored; an empty table gives an empty one.  The packing depends on how the table is dealt into tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(shared.value)
        packer, made = Packer(window), TaskContext.get().partitionId() << 32
        for b in batches:
            keys, sums, at = b.column(0).to_pylist(), np.cumsum(pc.binary_length(b.column(1)).to_numpy()), 0
            while at < len(sums):
                # a few megabytes of text at a time
                n = max(1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + CHUNK, "right")) - at)
                got, lengths = pieces.encode(b.column(1).slice(at, n))
                cut = np.cumsum(lengths)
                ids = np.insert(got, cut, end_id).astype("<u4")
                ends = cut + np.arange(1, n + 1)
                for key, a, z in zip(keys[at : at + n], (ends - lengths - 1).tolist(), ends.tolist(), strict=True):
                    packer.add(key, ids[a:z].copy())
                at += n
                if full := packer.taken():
                    yield _rows(full, made)
                    made += len(full)
        if rest := packer.taken() + packer.finish():
            yield _rows(rest, made)
        give_back()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).mapInArrow(run, _PIECE_SQL)


def packed_windows(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of the pieces of :func:`pack_documents`: each window's ids in order; a window is one row's worth."""
    own = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return own.select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["ids"])).alias("ids"))


def packing_digest(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """The rows of :func:`pack_documents` with a checksum in place of the ids."""
    made = pack_documents(docs, vocabulary_file)
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
