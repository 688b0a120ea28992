import hashlib
import re

import numpy as np
import pytest
from data import SCHEMA, table
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortframe.llm import fim

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
ODD = ["a<P>b c", "<S>", "x <M", "naïve café 漢字\U0001f600 z\n\n\tq", "É" * 40, "abc", "a", "ſK Kelvin K", "<<S", "<P", "line\r\nline"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(doc_id, text):
    text = text or ""
    w = TOKEN.findall(text)
    n, d = len(w), sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(w[:a]), "".join(w[a:z]), "".join(w[z:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    spm = h[3] % 100 < 20
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, "spm" if spm else "psm", len(pre), len(mid), sha(out), sha(text)


def key(r):
    return tuple("" if x is None else str(x) for x in r)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_equals_plain_version(spark, limit, monkeypatch):
    df, rows = table(spark)
    more = [(5000 + i, t, "en", "s", 1) for i, t in enumerate(ODD * 20)] + [(9000 + i, rows[0][1], "en", "hot", 1) for i in range(300)] + [(9999, "word " * 60_000, "en", "s", 1)]
    df = df.unionByName(spark.createDataFrame(more, SCHEMA))
    for c in ("index", "text_key", "bounds", "n", "form", "output", "copies", "cut"):
        df = df.withColumn(c, df["lang"])
    monkeypatch.setattr(fim.fill_in_middle, "__defaults__", (1, 90, 20, limit))
    got = sorted(key(r) for r in fim.fim_digest(df).collect())
    want = sorted(key(plain(r[0], r[1])) for r in [*rows, *more])
    assert got == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_empty(spark):
    assert fim.fim_digest(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab é<", max_size=400))
def test_boundaries_and_list(text):
    ends = fim.boundaries(text)
    assert ends.tolist() == np.cumsum([len(t) for t in TOKEN.findall(text)]).tolist()
    upto = len(text)
    read = fim.EliasFano(fim.elias_fano(ends, upto), len(ends), upto) if len(ends) else None
    if read:
        assert [read.select(k) for k in range(len(ends) + 1)] == [0, *ends.tolist()]


def test_list_is_small():
    ends = np.arange(1, 20_001) * 37
    data = fim.elias_fano(ends, int(ends[-1]))
    assert len(data) * 8 < 20_000 * (2 + 6) + 64
    read = fim.EliasFano(data, len(ends), int(ends[-1]))
    assert all(read.select(k) == 37 * k for k in range(0, 20_001, 97))
