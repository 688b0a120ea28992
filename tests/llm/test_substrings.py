import hashlib
from collections import Counter

import numpy as np
import pytest
from data import SCHEMA, table
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortframe.llm import passages, suffixes
from cohortframe.llm.common import least_places, word_hashes

BIG = 1 << 62


def plain_words(rows, size):
    docs = [(BIG if i is None else i, (t or "").encode().split(), i) for i, t, *_ in rows]
    first = {}
    for i, w, _ in docs:
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, BIG + 1), i)
    out = []
    for i, w, real in docs:
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                gone.update(range(p, p + size))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((real, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def plain_bytes(rows, depth):
    docs = sorted(((BIG if i is None else i, (t or "").encode(), i) for i, t, *_ in rows), key=lambda x: x[:2])
    seen, out = set(), []
    for _, t, real in docs:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - depth + 1):
            k = t[p : p + depth]
            if k in seen:
                gone[p : p + depth] = True
            seen.add(k)
        spans = int(np.sum(gone[:-1] & ~np.concatenate(([False], gone[:-2]))))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((real, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("seed,least,crowded", [(1, 1 << 30, 256), (2, 3000, 1), (3, 1500, 256)])
def test_passages(spark, monkeypatch, seed, least, crowded):
    real = passages.bucketed
    monkeypatch.setattr(passages, "bucketed", lambda d: real(d, least, least))
    df, rows = table(spark, seed)
    got = Counter(map(tuple, passages.passages_digest(df, 50, crowded, 20_000).collect()))
    assert got == plain_words(rows, 50)
    assert sum(n for (_, _, n, _), _ in got.items()) > 0


@pytest.mark.parametrize("seed,least,crowded", [(1, 1 << 30, 4096), (2, 3000, 1), (3, 1500, 4096)])
def test_bytes(spark, monkeypatch, seed, least, crowded):
    real = suffixes.bucketed
    monkeypatch.setattr(suffixes, "bucketed", lambda d: real(d, least, least))
    df, rows = table(spark, seed)
    from pyspark.sql import functions as F

    out = suffixes.remove_repeated_bytes(df, 100, crowded, 20_000).select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"]), F.size("spans"), F.sha2("kept", 256))
    assert Counter(map(tuple, out.collect())) == plain_bytes(rows, 100)


def test_words_of_equal_hash_are_told_apart(spark):
    """Two long words that any polynomial modulo a power of two gives one hash: a Thue-Morse string and its complement."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    assert word_hashes(one.encode())[0] == word_hashes(other.encode())[0]
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{one} {rest} end")]
    got = {r.doc_id: r.n_removed for r in passages.passages_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_copies_of_one_id_and_long_texts(spark):
    text = " ".join(f"w{i}" for i in range(90))
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    rows = [(7, text, ""), (7, text, ""), (7, "x " + text, ""), (None, text, ""), (None, text, ""), (9, long, ""), (10, long, "")]
    df = spark.createDataFrame(rows, SCHEMA.split(", lang")[0] + ", lang string")
    assert Counter(map(tuple, passages.passages_digest(df).collect())) == plain_words(rows, 50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 9))
def test_least_places(values, span):
    v = np.array(values, np.uint64)
    assert least_places(v, span).tolist() == [i + int(np.argmin(v[i : i + span])) for i in range(len(v) - span + 1)]


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert passages.passages_digest(df).count() == 0
    assert suffixes.bytes_digest(df).count() == 0
    clash = spark.createDataFrame([(1, "a b", 5, b"x")], "doc_id long, text string, bucket int, keys binary")
    assert passages.passages_digest(clash).first()["n_words"] == 2
    assert suffixes.bytes_digest(clash).first()["n_bytes"] == 3


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=1, max_size=80), st.integers(1, 12))
def test_previous_factors(text, depth):
    data = text.encode()
    starts = np.arange(max(0, len(data) - depth + 1))
    got = suffixes.previous_factors(data, starts, depth)
    assert got.tolist() == [any(data[q : q + depth] == data[p : p + depth] for q in range(p)) for p in starts]
