import zlib

import numpy as np
import public_tokenizers as P
from data import SCHEMA, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortframe.llm import bpe, tokenfile

ODD = ["<|endoftext|> a<|endoftext|>b <|startoftext|>", "it's we'LL  ÀÉ é ̈x y z\x85 \x1c!", "漢字 1234 ١٢ \U0001f600\U0001f600", "=" * 300 + "aaaa" * 50 + "ab" * 77, "İstanbul ΣΑΣ ß"]


def library(name):
    return Tokenizer.from_file(P.path(name))


def test_counts_equal_the_library(spark):
    df, rows = table(spark)
    df = df.unionByName(spark.createDataFrame([(2000 + i, t, "en", "s", 1) for i, t in enumerate(ODD)], SCHEMA))
    t = library("byte_bpe_50k.json")
    want = sorted((i if i is not None else -1, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in [(r[0], r[1]) for r in rows] + [(2000 + i, x) for i, x in enumerate(ODD)])
    got = bpe.token_counts(df, P.path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


_merger, _library = bpe.Merger(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()), library("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_any_text(text):
    assert _merger.texts([text]) == [len(_library.encode(text, add_special_tokens=False).ids)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_code_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = tokenfile.encode(v)
    assert tokenfile.decode(control, data, len(v)).tolist() == values


_pieces, _words = tokenfile.Pieces(open(P.path("word_bpe_49k.json"), encoding="utf-8").read()), library("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert _pieces.encode([text.encode()])[0].tolist() == _words.encode(text, add_special_tokens=False).ids


def test_ids_of_odd_texts():
    for t in [*ODD, "Word, word. é, É! x'S. &&,. a1, <|STARTOFTEXT|> A", "a\x01b \x01 c", "I\u0307, K\u030a. \u0130", "don't. 'S, don'T"]:
        assert _pieces.encode([t.encode()])[0].tolist() == _words.encode(t, add_special_tokens=False).ids


def test_token_file(spark):
    df, rows = table(spark)
    rows = [r[:2] for r in rows] + [(2000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    big, want, at = 1 << 62, [], 0
    for i, t in sorted(rows, key=lambda r: (big if r[0] is None else r[0], r[1] or "")):
        ids = [*_words.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = tokenfile.token_digest(df, P.path("word_bpe_49k.json"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert tokenfile.token_digest(spark.createDataFrame([], SCHEMA), P.path("word_bpe_49k.json")).count() == 0


def test_long_runs_without_a_break(spark):
    """A megabyte of letters: rounds merge what no other merge can forestall, so they stay few."""
    import random
    import time

    r = random.Random(1)
    for n in (3000, 40_000):
        text = "".join(r.choices("etaoinshrdlu", k=n))
        assert _merger.count([text.encode()]).tolist() == [len(_library.encode(text, add_special_tokens=False).ids)]
    began = time.thread_time()
    long = "".join(r.choices("etaoinshrdlu", k=1_000_000))
    got = bpe.token_counts(spark.createDataFrame([(1, long, 0)], "doc_id long, text string, n_bytes int"), P.path("byte_bpe_50k.json")).first()
    assert got.n_bytes == 1_000_000 and 300_000 < got.n_tokens < 700_000 and time.thread_time() - began < 60
    assert bpe.token_counts(spark.createDataFrame([], SCHEMA), P.path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text("abcdeh ", max_size=200))
def test_counts_of_few_letters(text):
    assert _merger.texts([text]) == [len(_library.encode(text, add_special_tokens=False).ids)]


def test_bytes_of_strings_are_cut_from_one_buffer():
    import pyarrow as pa

    a = pa.array(["", "ab", "é\x00", "漢字", ""])
    assert tokenfile._slices(a) == [v.encode() for v in a.to_pylist()]
    assert tokenfile._slices(a.slice(1, 3)) == [v.encode() for v in a.slice(1, 3).to_pylist()]
    assert tokenfile._slices(pa.array([], pa.string())) == [] and tokenfile._slices(pa.array([""])) == [b""]
