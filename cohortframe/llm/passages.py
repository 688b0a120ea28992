"""Substring dedup of word passages by fixed-block anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm import exchange as X
from cohortframe.llm.common import bucketed, depth_ranks, groups_of, least_places, materialize, mix, part_of, real_id, slices, window_hashes, word_hashes

_ANCHOR = 0xC2B2AE3D27D4EB4F
_OUT = "doc_id long, n_words long, spans array<struct<from: long, to: long>>, kept binary"


def _words(b: X.Bucket, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a bucket and the document it is in."""
    hashes, docs = [], []
    for first, end in b.chunks(chunk):
        part = b.texts[first:end]
        h, at = word_hashes(b" ".join(part))
        edge = np.cumsum([len(t) + 1 for t in part])
        hashes.append(h)
        docs.append(np.searchsorted(edge, at, "right") + first)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(docs)


def _windows(words: np.ndarray, doc: np.ndarray, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``size`` words, and which lie in one document."""
    h = window_hashes(words, size, base)
    return h, doc[: len(h)] == doc[size - 1 : size - 1 + len(h)]


def _distinct(keys: np.ndarray, doc: np.ndarray):
    """Sorted distinct keys; the order that sorts; where each starts; its first and last document."""
    order = np.argsort(keys, kind="stable")
    start = groups_of(keys[order])
    if not len(start):
        return keys, order, start, doc[:0], doc[:0]
    d = doc[order]
    return keys[order][start], order, start, np.minimum.reduceat(d, start), np.maximum.reduceat(d, start)


def _probe(window: int, parts: int):
    """Index and probes: a bucket's blocks at multiples of the block length, and all its rolling windows of that length."""
    block = window // 2

    def run(key: tuple, t: pa.Table) -> pa.Table:
        words, doc = _words(X.Bucket(t))
        h, whole = _windows(words, doc, block, _ANCHOR)
        first = np.searchsorted(doc, doc[: len(h)])
        aligned = (np.arange(len(h)) - first) % block == 0
        h, d, aligned = h[whole], doc[: len(h)][whole], aligned[whole]
        keys, order, start, low, high = _distinct(h, d)
        sure = np.maximum.reduceat(aligned[order], start) if len(start) else aligned
        return X.send(key[0].as_py(), keys, low != high, sure, parts)

    return run


def _segments(b: X.Bucket, told: X.Told, window: int):
    """The distinct segments around the anchors that were hit, and those the bucket has seen before.

    Each whole window goes to the least of the hit blocks it holds, so equal windows go to equal blocks, wherever they
    are.  A segment is the words of a run of windows of one block; blocks of crowded keys fall into single windows,
    which are dealt out by their own hash.  Segments: (range key, document, start, windows, text); seen before:
    (document, start, windows, number of the segment it equals).
    """
    block = window // 2
    words, doc = _words(b)
    h, whole = _windows(words, doc, block, _ANCHOR)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    value = np.where(whole & told.repeats(h), h, none)
    n = len(words) - window + 1
    if n <= 0:
        return [], []
    key = value[least_places(value, window - block + 1)]
    inside = (doc[:n] == doc[window - 1 :]) & (key != none)
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:n] != doc[: n - 1]) | (inside[1:] != inside[:-1])))
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    keep = inside[start]
    start, count = start[keep], count[keep]
    crowded = told.is_crowded(key[start])
    spread = mix(key[start] + np.uint64(_ANCHOR))
    begin = np.searchsorted(doc, np.arange(len(b.ids)))
    seen: dict[bytes, int] = {}
    distinct, again, last, own = [], [], -1, []
    for i, many in enumerate(crowded.tolist()):
        d = int(doc[start[i]])
        if d != last:
            last, own = d, b.texts[d].split()
        s, c = int(start[i] - begin[d]), int(count[i])
        for x, k in [(s, c)] if not many else [(x, 1) for x in range(s, s + c)]:
            piece = b" ".join(own[x : x + k + window - 1])
            at = seen.setdefault(piece, len(distinct))
            if at < len(distinct):
                again.append((d, x, k, at))
            else:
                distinct.append((xxhash.xxh3_64_intdigest(piece) if many else int(spread[i]), d, x, k, piece))
    return distinct, again


def _told(t: pa.Table, parts: int) -> X.Told:
    return X.Told(t.column("part").to_pylist(), t.column("keys").to_pylist(), parts)


def _send(window: int, parts: int, ranges: int):
    """Hits extended to segments of words, sent to ranges of keys."""

    def run(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if told.num_rows:
            b = X.Bucket(t)
            found, _ = _segments(b, _told(told, parts), window)
            part = part_of(np.array([f[0] for f in found], np.uint64), ranges)
            for p in np.unique(part):
                own = [found[i] for i in np.flatnonzero(part == p)]
                doc, start, count = (np.array([f[k] for f in own], np.int64) for k in (1, 2, 3))
                rows.append({"part": int(p), "bucket": key[0].as_py(), "ids": b.ids[doc].tobytes(), "docs": doc.tobytes(), "starts": start.tobytes(), "counts": count.tobytes(), "text": b" ".join(f[4] for f in own)})
        return pa.Table.from_pylist(rows, schema=X.SEGMENT)

    return run


def _judge(window: int):
    """Of one range of segments: the runs of windows whose words start in a smaller document, told to each bucket.

    Words are compared as they are: each gets a number of its own, and windows get ranks by prefix doubling.
    """

    def run(t: pa.Table) -> pa.Table:
        ids, doc, start, count = (np.concatenate([np.frombuffer(x, np.int64) for x in t.column(c).to_pylist()]) for c in ("ids", "docs", "starts", "counts"))
        bucket = np.repeat(t.column("bucket").to_numpy(), [len(x) // 8 for x in t.column("ids").to_pylist()])
        words = b" ".join(t.column("text").to_pylist()).split()
        number = {w: i for i, w in enumerate(set(words), 1)}
        rank = depth_ranks(np.fromiter(map(number.__getitem__, words), np.uint64, len(words)), window)
        size = count + window - 1
        base = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(ids)), count)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        r, own = rank[base[owner] + within].astype(np.int64), ids[owner]
        least = np.full(len(words) + 2, np.iinfo(np.int64).max)
        np.minimum.at(least, r, own)
        late = np.flatnonzero(own > least[r])
        new = np.concatenate(([True], (late[1:] != late[:-1] + 1) | (owner[late[1:]] != owner[late[:-1]])))[: len(late)]
        first = np.flatnonzero(new)
        a, z = late[first], late[np.append(first[1:] - 1, len(late) - 1)] if len(late) else late
        seg = owner[a]
        every = np.stack((bucket[seg], doc[seg], start[seg], start[seg] + within[a], start[seg] + within[z] + window), 1)
        every = every[np.argsort(every[:, 0], kind="stable")]
        return X.table([(-1, int(every[i, 0]), every[i:j, 1:].tobytes()) for i, j in slices(groups_of(every[:, 0]), len(every))])

    return run


def _cuts(b: X.Bucket, said: pa.Table, window: int, parts: int) -> list[np.ndarray]:
    """(document, from, to) of all removed runs of a bucket."""
    verdict = np.array([p < 0 for p in said.column("part").to_pylist()])
    late = np.concatenate([np.empty((0, 4), np.int64), *(np.frombuffer(x, np.int64).reshape(-1, 4) for x in said.filter(pa.array(verdict)).column("keys").to_pylist())])
    cuts = [late[:, [0, 2, 3]]]
    told = said.filter(pa.array(~verdict))
    if told.num_rows:
        distinct, again = _segments(b, _told(told, parts), window)
        judged: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, s, x, y in late.tolist():
            judged.setdefault((d, s), []).append((x - s, y - s))
        own = []
        for d, s, n, at in again:
            _, first, begin, _, _ = distinct[at]
            # a copy in a larger document goes whole; one of the same doc_id fares as the first
            runs = [(0, n + window - 1)] if b.ids[d] > b.ids[first] else judged.get((first, begin), [])
            own += [(d, s + x, s + y) for x, y in runs]
        cuts.append(np.array(own, np.int64).reshape(-1, 3))
    return cuts


def _cut(window: int, parts: int):
    def run(key: tuple, t: pa.Table, said: pa.Table) -> pa.Table:
        b = X.Bucket(t)
        every = np.concatenate(_cuts(b, said, window, parts)) if said.num_rows else np.empty((0, 3), np.int64)
        every = every[np.argsort(every[:, 0], kind="stable")]
        edge = np.searchsorted(every[:, 0], np.arange(len(b.ids) + 1))
        spans, kept, sizes = [], [], []
        for i, text in enumerate(b.texts):
            own, out = text.split(), []
            sizes.append(len(own))
            if edge[i] < edge[i + 1]:
                cover = np.zeros(len(own) + 1, np.int64)
                np.add.at(cover, every[edge[i] : edge[i + 1], 1], 1)
                np.add.at(cover, every[edge[i] : edge[i + 1], 2], -1)
                gone = np.cumsum(cover[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8))).tolist()
                out = [{"from": x, "to": y} for x, y in zip(turn[0::2], turn[1::2], strict=True)]
                own = [own[j] for j in np.flatnonzero(~gone).tolist()]
            spans.append(out)
            kept.append(b" ".join(own))
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return pa.table({"doc_id": pa.array(b.ids), "n_words": pa.array(sizes, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    return run


def remove_repeated_passages(docs: DataFrame, window: int = 50, crowded: int = 256, range_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_words, spans, kept) for every row of ``docs``.

    Every word goes that a window of ``window`` consecutive words covers whose sequence also starts in a
    document with a smaller doc_id, as the input stands.  ``spans`` are the removed runs of words [from, to);
    ``kept`` the UTF-8 bytes of the other words, joined by a space.

    Blocks of window/2 words at multiples of that length are indexed and every rolling window of that length
    probes the index; any whole window holds a block of each document it is in, so no repeat
    is missed.  Hits extend to the whole windows around them; segments that share a block meet in one range of keys, where
    their words themselves are compared, so hashes only choose what is compared.  The union of repeated windows is the maximal
    repeat.  A segment that many documents share is sent once per bucket of documents, and blocks that more than
    ``crowded`` buckets hold are dealt out window by window.

    Null texts have no words.  A null doc_id comes after all others.  Rows with one doc_id
    are separate documents, none smaller.  Other columns are ignored; an empty table gives an empty one.
    """
    rows, n = bucketed(docs)
    sent = rows.groupBy("bucket").applyInArrow(_probe(window, n), X.SCHEMA)
    told = materialize(X.repeated(sent, crowded), "anchors")
    keys = (told.agg(F.sum(F.length("keys"))).first()[0] or 0) // 5
    ranges = max(1, keys * 2 * window // range_bytes)
    parts = rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_send(window, n, ranges), X.SEGMENT_SQL)
    late = materialize(parts.groupBy("part").applyInArrow(_judge(window), X.SCHEMA), "windows")
    out = rows.groupBy("bucket").cogroup(told.unionByName(late).groupBy("bucket")).applyInArrow(_cut(window, n), _OUT)
    return out.withColumn("doc_id", real_id())


def passages_digest(docs: DataFrame, window: int = 50, crowded: int = 256, range_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    out = remove_repeated_passages(docs, window, crowded, range_bytes)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
