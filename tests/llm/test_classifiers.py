import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortframe.llm import quality, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=3, max_size=7), min_size=1, max_size=5), st.text("abc", min_size=1, max_size=8), st.integers(1, 2))
def test_automaton_meets_trie(terms, word, edits):
    assert toxicity.Trie(terms).near(word, edits) == any(distance(t, word) <= edits for t in terms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=5, max_size=8), st.booleans()), min_size=1, max_size=6), st.text("abc", min_size=1, max_size=10))
def test_lexicon_equals_edit_distance(terms, word):
    """Starting the automaton below matching halves loses no term within one edit."""
    lexicon = toxicity.Lexicon([t + "*" if o else t for t, o in terms])
    begins = [word[:k] for k in range(len(word) + 1)]
    exact = any(word.startswith(t) if o else word == t for t, o in terms)
    near = len(word) >= 4 and any(min(distance(t, b) for b in begins) <= 1 if o else distance(t, word) <= 1 for t, o in terms)
    assert lexicon.kind(word) == (2 if exact else int(near))


def test_more_terms_than_any_round_number(spark):
    """Every learnt term is kept, however many there are."""
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(2600)]
    rows = [(i, 1, " ".join(f"{w} x{i}y{j}" for j, w in enumerate(words))) for i in range(5)] + [(9, 0, "other text")]
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, y int, text string"))
    assert set(words) <= {w for w in words if any(w == t or t.endswith("*") and w.startswith(t[:-1]) for t in found)}


def test_open_terms():
    lexicon = toxicity.Lexicon(["stupid", "lowei*"])
    assert [lexicon.kind(w) for w in ("stupid", "stuped", "stupids", "loweischaft", "lovei", "stone", "loweix")] == [2, 1, 1, 2, 1, 0, 2]
    quoted, plain = lexicon.features('he said "stupid" things'), lexicon.features("what a stupid thing")
    assert quoted[0] == 0 < quoted[2] and plain[2] == 0 < plain[0]


def corpus(spark, n=400):
    r = random.Random(4)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = r.choices(vocab, k=r.randint(40, 150))
        toxic, good = int(r.random() < 0.25), int(r.random() < 0.8)
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vermin", "dolt", "wretch"]))
        text = " ".join(words).capitalize() + "." if good else r.choice([" ".join(w.upper() + "!!" for w in words), " ".join(words[:3] * 30), " | ".join(words)])
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, good, toxic))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (None, "some text", "en", "s", 9)]
    labels += [(n, None, None), (None, 1, 1), (5, labels[5][1], labels[5][2])]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, (b, c)) for a, b, c in labels)


@pytest.mark.parametrize("score,which,least", [(quality.quality_scores, 0, 0.3), (toxicity.toxicity_scores, 1, 0.5)])
def test_held_out_accuracy(spark, score, which, least):
    docs, labels, truth = corpus(spark)
    got = score(docs, labels).collect()
    assert len(got) == 403
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    out = [(r.predicted, truth[r.doc_id][which]) for r in got if r.held_out and r.doc_id < 400]
    assert np.mean([a == b for a, b in out]) > 0.9
    none = score(docs, labels.where("doc_id < 0")).collect()
    assert len(none) == 403
    assert score(docs.limit(0), labels).count() == 0


def test_prior_from_positives_and_unlabelled():
    r = np.random.default_rng(1)
    for prior in (0.3, 0.6, 0.9):
        good = r.normal(0, 1, (12_000, 4)) + [3, 0, 0, 0]
        bad = r.normal(0, 1, (6_000, 4)) - [1, 0, 0, 0]
        k = int(6000 * prior)
        u = np.concatenate((good[6000 : 6000 + k], bad[: 6000 - k]))
        assert abs(quality.estimate_prior(good[:3000], u) - prior) < 0.05


def test_risk_gradients():
    """One step of the fit against numeric gradients of the risk it states."""
    r = np.random.default_rng(2)
    net = quality.Network(3, 4, 1)
    zp, zu, prior = r.normal(0, 1, (20, 3)), r.normal(0, 1, (30, 3)), 0.4

    def risk():
        gp, gu = net._forward(zp)[1], net._forward(zu)[1]
        negative = quality.sigmoid(gu).mean() - prior * quality.sigmoid(gp).mean()
        return prior * quality.sigmoid(-gp).mean() + max(0.0, negative), negative

    grads, negative = quality.risk_gradients(net, zp, zu, prior)
    assert negative == pytest.approx(risk()[1]) and negative > 0
    for w, g in zip(net.w, grads):
        for i in np.ndindex(w.shape):
            w[i] += 1e-6
            up = risk()[0]
            w[i] -= 2e-6
            down = risk()[0]
            w[i] += 1e-6
            assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_repeated_labelled_rows_are_bounded(spark):
    docs = spark.range(4000).selectExpr("5L as doc_id", "cast(id as string) as text")
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    from cohortframe.llm.classify import labelled

    assert labelled(docs, labels, "quality", 100).count() < 400


def test_clashing_columns(spark):
    docs, labels, _ = corpus(spark, 60)
    more = docs.selectExpr("*", "1 as y", "2 as x", "3 as g", "4 as score", "5 as text_key", "6 as held_out")
    assert quality.quality_scores(more, labels).count() == toxicity.toxicity_scores(more, labels).count() == 63


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_do_not_depend_on_partitions(spark, score):
    docs, labels, _ = corpus(spark, 200)
    docs = docs.unionByName(docs.limit(20))  # repeated rows

    def scores(n):
        return sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 9)) for r in score(docs.repartition(n, "text" if n > 3 else "doc_id"), labels).collect())

    assert scores(2) == scores(7)
