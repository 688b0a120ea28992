import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from data import SCHEMA, table
from tokenizers import Tokenizer

from cohortframe.llm import packing

FILE = P.path("word_bpe_49k.json")


def check(pieces, docs, window):
    """Every id lies in one piece, windows have no gaps and need no padding; pieces: (doc, start, length, sum, doc_tokens, window, offset)."""
    by_window, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_window[p[5]].append(p)
        by_doc[p[0], p[4]].append(p)
    for own in by_window.values():
        at = 0
        for p in sorted(own, key=lambda p: p[6]):
            assert p[6] == at and p[2] > 0
            at += p[2]
        assert at == window or at & (at - 1) == 0 and at < window
    left = defaultdict(list)
    for doc, ids in docs:
        left[doc, len(ids)].append(ids)
    assert set(left) == set(by_doc)
    for k, copies in left.items():
        own = sorted((p[1], p[2], p[3]) for p in by_doc[k])
        assert sum(x[1] for x in own) == k[1] * len(copies)
        sums = {(a, n): {zlib.crc32(ids[a : a + n].tobytes()) for ids in copies} for a, n, _ in own}
        assert all(x[2] in sums[x[:2]] for x in own)
        cover = np.zeros(k[1], int)
        for a, n, _ in own:
            cover[a : a + n] += 1
        assert (cover == len(copies)).all()
    return by_window


def test_query_equals_library(spark):
    df, rows = table(spark)
    rows = [*rows, (7000, "long words here " * 40_000, "en", "s", 1)]
    df = df.unionByName(spark.createDataFrame(rows[-1:], SCHEMA)).withColumn("ids", df["lang"]).withColumn("start", df["lang"])
    t = Tokenizer.from_file(FILE)
    docs = [(r[0], np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")) for r in rows]
    got = [tuple(r) for r in packing.packing_digest(df, FILE).collect()]
    check(got, docs, 4096)
    whole = packing.packed_windows(packing.pack_documents(df, FILE)).collect()
    assert sum(r.n_tokens for r in whole) == sum(len(ids) for _, ids in docs)
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert sorted(x for r in whole for x in np.frombuffer(r.ids, "<u4").tolist()) == sorted(x for _, ids in docs for x in ids.tolist())


def test_empty(spark):
    assert packing.packing_digest(spark.createDataFrame([], SCHEMA), FILE).count() == 0


def plain_level(count, size, window):
    """The rule, level by level."""
    best = None
    for at in [h for h in range(window - size, 0, -1) if count[h]] + [0]:
        after = count.copy()
        if at:
            after[at] -= 1
        if at + size < window:
            after[at + size] += 1
        cost = int((after[1:window] ** 2).sum())
        if best is None or cost < best[0]:
            best = cost, at
    return best[1]


@pytest.mark.parametrize("seed", range(4))
def test_sum_of_squares(seed):
    r = np.random.default_rng(seed)
    window, packer, docs = 32, packing.Packer(32), []
    for i in range(400):
        ids = r.integers(0, 1000, r.integers(1, 50)).astype("<u4")
        rest = len(ids) % window
        want = plain_level(packer.count, rest, window) if rest else None
        before = packer.count.copy()
        packer.add(i, ids)
        docs.append((i, ids))
        if rest:
            before[want] -= want > 0
            before[want + rest] += want + rest < window
            assert (packer.count == before).all()
        assert [len(packer.open.get(h, [])) for h in range(1, window)] == packer.count[1:window].tolist()
    held = sum(len(w) for w in packer.open.values())
    assert held < 40
    windows = packer.taken() + packer.finish()
    pieces = [(d, s, len(ids), zlib.crc32(ids.tobytes()), n, k, sum(len(p[2]) for p in w[:j])) for k, w in enumerate(windows) for j, (d, s, ids, n) in enumerate(w)]
    by = check(pieces, docs, window)
    assert sum(sum(p[2] for p in w) < window for w in by.values()) <= 5
