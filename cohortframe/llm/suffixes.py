"""Substring dedup of bytes by longest-previous-factor arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm import exchange as X
from cohortframe.llm.common import _BYTE, bucketed, depth_ranks, groups_of, least_places, materialize, mix, part_of, real_id, slices, window_hashes

_GRAM = 24
_OUT = "doc_id long, n_bytes long, spans array<struct<from: long, to: long>>, kept binary"


# --- suffix order of one text ----------------------------------------------------------


def _smaller(pos: np.ndarray) -> np.ndarray:
    """For each place of a sequence the nearest place before it with a smaller value, or -1."""
    out = np.arange(-1, len(pos) - 1)
    todo = np.flatnonzero((out >= 0) & (pos[out] > pos))
    while len(todo):
        out[todo] = out[out[todo]]
        todo = todo[(out[todo] >= 0) & (pos[out[todo]] > pos[todo])]
    return out


def previous_factors(text: bytes, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each of the ``starts`` (ascending): does its next ``depth`` bytes also begin at an earlier one?

    That is, is its longest previous factor ``depth`` or longer.  The suffixes are put in order (to
    ``depth`` bytes, ties by place); the earlier suffix with the longest common prefix is
    the nearest smaller place before or after it in that order.
    """
    rank = depth_ranks(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1), depth)[starts]
    order = np.argsort(rank, kind="stable")
    place, r = starts[order], rank[order]
    before = _smaller(place)
    after = len(place) - 1 - _smaller(place[::-1])[::-1]
    found = (before >= 0) & (r[before] == r)
    inside = after < len(place)
    found[inside] |= r[after[inside]] == r[inside]
    out = np.zeros(len(starts), bool)
    out[order] = found
    return out


# --- candidate segments -----------------------------------------------------------------


class Runs:
    """Runs of window starts of a bucket that share their least gram.

    Windows of ``depth`` bytes that are equal have the same least gram at the same place, so equal windows
    lie in runs of one key.
    """

    def __init__(self, b: X.Bucket, depth: int, chunk: int = 1 << 18) -> None:
        parts = [self._chunk(b.texts[i:j], i, depth) for i, j in b.chunks(chunk)]
        cols = list(zip(*parts, strict=True)) if parts else [[np.empty(0, k)] for k in (np.uint64, np.int64, np.int64, np.int64, bool)]
        self.key, self.doc, self.start, self.count, self.own = (np.concatenate(c) for c in cols)

    @staticmethod
    def _chunk(texts: list[bytes], first: int, depth: int) -> tuple[np.ndarray, ...]:
        blob = b"".join(texts)
        size = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(size) - size
        n = len(blob) - depth + 1
        if n <= 0:
            return tuple(np.empty(0, k) for k in (np.uint64, np.int64, np.int64, np.int64, bool))
        gram = window_hashes(np.frombuffer(blob, np.uint8).astype(np.uint64) + np.uint64(1), _GRAM, _BYTE)
        at = least_places(gram, depth - _GRAM + 1)
        # least values crowd at the low end: mixed again, they spread over all ranges
        key = mix(gram[at] + np.uint64(_BYTE))
        doc = np.repeat(np.arange(len(texts)), size)
        whole = doc[:n] == doc[depth - 1 : depth - 1 + n]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:n] != doc[: n - 1]) | (whole[1:] != whole[:-1])))
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, n))
        moved = np.concatenate(([False], at[1:] != at[:-1])) & ~new
        own = np.add.reduceat(moved, start) > 0
        keep = whole[start]
        start, count, own = start[keep], count[keep], own[keep]
        return key[start], doc[start] + first, start - base[doc[start]], count, own


def _segments(b: X.Bucket, told: X.Told, depth: int):
    """The distinct segments of repeated runs in order of place, and those seen before in the bucket.

    A run's segment is the text of all its windows.  Runs of crowded keys fall into single windows, which
    are dealt out by their own hash.  Segments: (range key, document, start, count, text).
    """
    runs = Runs(b, depth)
    which = np.flatnonzero(told.repeats(runs.key))
    crowded = told.is_crowded(runs.key[which])
    seen: set[bytes] = set()
    distinct, again = [], []
    for i, many in zip(which.tolist(), crowded.tolist(), strict=True):
        d, s, n = int(runs.doc[i]), int(runs.start[i]), int(runs.count[i])
        text, key = b.texts[d], int(runs.key[i])
        for a, c in [(s, n)] if not many else [(x, 1) for x in range(s, s + n)]:
            piece = text[a : a + c + depth - 1]
            if piece in seen:
                again.append((d, a, a + c + depth - 1))
            else:
                seen.add(piece)
                distinct.append((xxhash.xxh3_64_intdigest(piece) if many else key, d, a, c, piece))
    return distinct, again


def _probe(depth: int, parts: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        runs = Runs(X.Bucket(t), depth)
        order = np.argsort(runs.key, kind="stable")
        keys = runs.key[order]
        start = groups_of(keys)
        multi = (np.diff(np.append(start, len(keys))) > 1) | (np.maximum.reduceat(runs.own[order], start) if len(start) else np.zeros(0, bool))
        return X.send(key[0].as_py(), keys[start], multi, np.ones(len(start), bool), parts)

    return run


def _told(t: pa.Table, parts: int) -> X.Told:
    return X.Told(t.column("part").to_pylist(), t.column("keys").to_pylist(), parts)


def _send(depth: int, parts: int, ranges: int):
    def run(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if told.num_rows:
            b = X.Bucket(t)
            found, _ = _segments(b, _told(told, parts), depth)
            part = part_of(np.array([f[0] for f in found], np.uint64), ranges)
            for p in np.unique(part):
                own = [found[i] for i in np.flatnonzero(part == p)]
                doc = np.array([f[1] for f in own], np.int64)
                rows.append({"part": int(p), "bucket": key[0].as_py(), "ids": b.ids[doc].tobytes(), "docs": doc.tobytes(), "starts": np.array([f[2] for f in own], np.int64).tobytes(), "counts": np.array([f[3] for f in own], np.int64).tobytes(), "text": b"".join(f[4] for f in own)})
        return pa.Table.from_pylist(rows, schema=X.SEGMENT)

    return run


def _judge(depth: int):
    """Of one range of segments: the runs of bytes to remove, told to each bucket."""

    def run(t: pa.Table) -> pa.Table:
        ids, doc, start, count = (np.concatenate([np.frombuffer(x, np.int64) for x in t.column(c).to_pylist()]) for c in ("ids", "docs", "starts", "counts"))
        lengths = [len(x) // 8 for x in t.column("ids").to_pylist()]
        bucket = np.repeat(t.column("bucket").to_numpy(), lengths)
        blob = b"".join(t.column("text").to_pylist())
        size = count + depth - 1
        offset = np.cumsum(size) - size
        first: dict[bytes, int] = {}
        order = np.lexsort((start, doc, ids))
        pieces, chosen, out = [], [], []
        for i in order.tolist():
            piece = blob[offset[i] : offset[i] + size[i]]
            if piece in first:
                out.append((bucket[i], doc[i], start[i], start[i] + size[i]))
            else:
                first[piece] = i
                pieces.append(piece)
                chosen.append(i)
        chosen = np.array(chosen, np.int64)
        n = count[chosen]
        base = np.cumsum(size[chosen]) - size[chosen]
        # the windows of all segments as places in one text
        owner = np.repeat(np.arange(len(chosen)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        gone = previous_factors(b"".join(pieces), base[owner] + within, depth)
        at = np.flatnonzero(gone)
        if len(at):
            new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])))
            a = at[np.flatnonzero(new)]
            z = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
            seg = chosen[owner[a]]
            out += zip(bucket[seg], doc[seg], start[seg] + within[a], start[seg] + within[z] + depth, strict=True)
        every = np.array(out, np.int64).reshape(-1, 4)
        every = every[np.argsort(every[:, 0], kind="stable")]
        return X.table([(-1, int(every[i, 0]), every[i:j, 1:].tobytes()) for i, j in slices(groups_of(every[:, 0]), len(every))])

    return run


def _cut(depth: int, parts: int):
    def run(key: tuple, t: pa.Table, said: pa.Table) -> pa.Table:
        b = X.Bucket(t)
        cuts = [np.empty((0, 3), np.int64)]
        if said.num_rows:
            verdict = np.array([p < 0 for p in said.column("part").to_pylist()])
            told = said.filter(pa.array(~verdict))
            if told.num_rows:
                cuts.append(np.array(_segments(b, _told(told, parts), depth)[1], np.int64).reshape(-1, 3))
            cuts += [np.frombuffer(x, np.int64).reshape(-1, 3) for x in said.filter(pa.array(verdict)).column("keys").to_pylist()]
        every = np.concatenate(cuts)
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        edge = np.searchsorted(every[:, 0], np.arange(len(b.ids) + 1))
        spans, kept = [], []
        for i, text in enumerate(b.texts):
            own, rest, last = [], [], 0
            for _, x, y in every[edge[i] : edge[i + 1]].tolist():
                if own and x <= own[-1]["to"]:
                    own[-1]["to"] = max(y, own[-1]["to"])
                else:
                    own.append({"from": x, "to": y})
            for s in own:
                rest.append(text[last : s["from"]])
                last = s["to"]
            rest.append(text[last:])
            spans.append(own)
            kept.append(b"".join(rest))
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return pa.table({"doc_id": pa.array(b.ids), "n_bytes": pa.array([len(x) for x in b.texts], pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    return run


def remove_repeated_bytes(docs: DataFrame, depth: int = 100, crowded: int = 4096, range_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of ``docs``.

    Every byte goes that a string of ``depth`` bytes covers which also starts earlier: in a smaller doc_id,
    or before in the same document; overlaps count; strings are judged as the input stands.
    ``spans`` are the maximal removed runs [from, to), ``kept`` the other bytes.

    A string's least gram (of 24 bytes, by hash) sends it to a range of keys, so equal strings meet in one
    range, where the segments are laid end to end in corpus order and the longest-previous-factor array
    of that text tells which strings occurred before.  Keys seen once in the corpus send no text, a
    segment is sent once per bucket of documents, and the windows of keys that more than
    ``crowded`` buckets hold are dealt out one by one by their own hash.

    Null texts are empty.  A null doc_id comes after all others.  Rows with one doc_id are separate
    documents in the order of their texts.  Other columns are ignored; an empty table gives an empty one.
    """
    if depth < _GRAM:
        raise ValueError(f"depth must be {_GRAM} or more")
    rows, n = bucketed(docs)
    sent = rows.groupBy("bucket").applyInArrow(_probe(depth, n), X.SCHEMA)
    told = materialize(X.repeated(sent, crowded), "grams")
    keys = (told.agg(F.sum(F.length("keys"))).first()[0] or 0) // 5
    ranges = max(1, keys * 2 * depth // range_bytes)
    parts = rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_send(depth, n, ranges), X.SEGMENT_SQL)
    late = materialize(parts.groupBy("part").applyInArrow(_judge(depth), X.SCHEMA), "factors")
    out = rows.groupBy("bucket").cogroup(told.unionByName(late).groupBy("bucket")).applyInArrow(_cut(depth, n), _OUT)
    return out.withColumn("doc_id", real_id())


def bytes_digest(docs: DataFrame, depth: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    out = remove_repeated_bytes(docs, depth)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
