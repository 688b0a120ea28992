"""Toxicity by a learned lexicon, matched with Levenshtein automata, and context windows."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.classify import Adam, held_out, labelled, sigmoid
from cohortframe.llm.common import materialize
from cohortframe.plans.ship import ship

_WORD = re.compile(r"[^\W_]+(?:[@$!*0-9][^\W_]+)*")
#: Signs of quotation or report around a match, and of address.
REPORT = frozenset("said says wrote writes quote quoted quotes called calling reported cited slur term word insult dijo dit sagte schrieb".split())
ADDRESS = frozenset("you your youre u are is du bist tu eres es vous te toi dich".split())
QUOTES = "\"'“”«»„‘’`"
FEATURES = 6


class Trie:
    """Terms; those that end in ``*`` match any continuation."""

    def __init__(self, terms: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.whole: list[bool] = [False]
        self.open: list[bool] = [False]
        for term in terms:
            at = 0
            for c in term.rstrip("*"):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.whole.append(False)
                    self.open.append(False)
                at = self.next[at][c]
            self.whole[at] |= not term.endswith("*")
            self.open[at] |= term.endswith("*")

    def node(self, beginning: str) -> int:
        """The node that a beginning of some term leads to."""
        at = 0
        for c in beginning:
            at = self.next[at][c]
        return at

    def near(self, word: str, edits: int = 1, node: int = 0) -> bool:
        """Does the Levenshtein automaton of ``word`` meet, below ``node``, what is left of a term within ``edits`` edits?

        The automaton's state is one bit set per number of errors: bit i stands for i letters of the word that
        are used up.  States are carried down the trie; a branch ends when its last set is empty.
        """
        letters: dict[str, int] = {}
        for i, c in enumerate(word):
            letters[c] = letters.get(c, 0) | 1 << i
        every, end = (2 << len(word)) - 1, 1 << len(word)
        state = tuple((2 << e) - 1 & every for e in range(edits + 1))
        stack = [(node, state)]
        while stack:
            node, state = stack.pop()
            if self.open[node] or (self.whole[node] and state[-1] & end):
                return True
            for c, child in self.next[node].items():
                same, new, below, last = letters.get(c, 0), [], 0, 0
                for now in state:
                    # the letter meets the word's next one; or it stands for another, or for none; or the word has one more
                    made = ((now & same) << 1 | below | below << 1 | last | last << 1) & every
                    new.append(made)
                    below, last = now, made
                if last:
                    stack.append((child, tuple(new)))
        return False


class Lexicon:
    """Matches words against a lexicon.

    Each distinct word is judged once and remembered, up to ``keep`` words.  A word within one edit of a term
    holds either half of it unchanged, so the automaton starts below that half: for first halves in a trie of
    the terms, for second halves (one place off at most) in a trie of the terms read backwards.
    """

    def __init__(self, terms: list[str], least: int = 5, keep: int = 400_000) -> None:
        self.least, self.keep = least, keep
        self.whole = {t for t in terms if not t.endswith("*")}
        self.begin: dict[int, set[str]] = {}
        for t in terms:
            if t.endswith("*"):
                self.begin.setdefault(len(t) - 1, set()).add(t[:-1])
        fuzzy = sorted({t for t in terms if len(t.rstrip("*")) >= least})
        self.forth = Trie(fuzzy)
        self.back = {o: Trie([t.rstrip("*")[::-1] for t in fuzzy if t.endswith("*") == o]) for o in (False, True)}
        self.heads: dict[int, dict[str, int]] = {}
        self.tails: dict[tuple[int, int, bool], dict[str, int]] = {}
        for t in fuzzy:
            word, is_open = t.rstrip("*"), t.endswith("*")
            k = len(word) // 2
            self.heads.setdefault(k, {})[word[:k]] = self.forth.node(word[:k])
            self.tails.setdefault((k, len(word) - k, is_open), {})[word[k:]] = self.back[is_open].node(word[:k - 1 : -1])
        self.none: set[str] = set()
        self.hits: dict[str, int] = {}

    def _judge(self, word: str) -> int:
        if word in self.whole or any(word[:k] in b for k, b in self.begin.items()):
            return 2
        return int(len(word) >= self.least - 1 and self._misspelt(word))

    def _misspelt(self, word: str) -> bool:
        for k, heads in self.heads.items():
            at = heads.get(word[:k])
            if at is not None and self.forth.near(word[k:], 1, at):
                return True
        for (k, n, is_open), tails in self.tails.items():
            for i in (k - 1, k, k + 1) if is_open else (len(word) - n,):
                at = tails.get(word[i : i + n]) if i >= 0 else None
                if at is not None and self.back[is_open].near(word[:i][::-1], 1, at):
                    return True
        return False

    def kind(self, word: str) -> int:
        """2: a term; 1: a misspelt term; 0: neither."""
        self.learn({word})
        return self.hits.get(word, 0)

    def learn(self, words: set[str]) -> None:
        """Judge the words not seen yet."""
        if len(self.none) + len(self.hits) > self.keep:
            self.none, self.hits = set(), {}
        for w in words - self.none:
            if w not in self.hits:
                k = self._judge(w)
                if k:
                    self.hits[w] = k
                else:
                    self.none.add(w)

    def features(self, text: str, window: int = 8) -> np.ndarray:
        """Matches of a text, split by context: exact and misspelt, in abuse and in quotation, density, address."""
        out = np.zeros(FEATURES)
        low = text.lower()
        words = _WORD.findall(low)
        kinds = set(words)
        self.learn(kinds)
        if self.hits.keys().isdisjoint(kinds):
            return out
        places = None
        for i, w in enumerate(words):
            k = self.hits.get(w, 0)
            if not k:
                continue
            places = places or [m.span() for m in _WORD.finditer(low)]
            around = words[max(0, i - window) : i] + words[i + 1 : i + 1 + window]
            a, z = places[i]
            quoted = (a > 0 and low[a - 1] in QUOTES) or (z < len(low) and low[z] in QUOTES) or not REPORT.isdisjoint(around)
            out[(0 if k == 2 else 1) + (2 if quoted else 0)] += 1
            out[4] += not ADDRESS.isdisjoint(around)
        out[:5] = np.log1p(out[:5])
        out[5] = np.log1p(out[:4].sum() * 100 / (1 + len(words)))
        return out


#: One lexicon per Python worker, by its terms: tasks that follow find its words judged.
_kept: dict[tuple[str, ...], Lexicon] = {}


def _lexicon(terms: tuple[str, ...]) -> Lexicon:
    if terms not in _kept:
        _kept.clear()
        _kept[terms] = Lexicon(list(terms))
    return _kept[terms]


_LONGEST = 7
_PLAIN = re.compile(r"[^\W_]+")


def _marks(word: str, least: int = 4) -> list[str]:
    """The terms that a word is an instance of: itself and its beginnings."""
    return [word, *(word[:k] + "*" for k in range(least, min(_LONGEST, len(word) - 1) + 1))] if len(word) >= least else []


def _toxic_terms(keep: int = 300_000):
    """Per term of toxic texts and place (hash of the words beside it): how many texts, the first and last word it stands for."""

    def rows(found: dict[tuple[str, int], list]) -> pa.RecordBatch:
        t, c = zip(*found, strict=True)
        p, lo, hi = zip(*found.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(c, pa.int64()), pa.array(p, pa.int64()), pa.array(lo), pa.array(hi)], ["t", "c", "p", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                words = ["", *_PLAIN.findall(text.lower()), ""]
                first = {words[i]: i for i in range(len(words) - 2, 0, -1)}
                own: dict[str, tuple[str, str, int]] = {}
                for w, i in sorted(first.items()):
                    marks = _marks(w)
                    if marks:
                        beside = zlib.crc32(f"{words[i - 1]} {words[i + 1]}".encode())
                        for t in marks:
                            own[t] = (own[t][0], w, own[t][2]) if t in own else (w, w, beside)
                for t, (lo, hi, c) in own.items():
                    have = found.get((t, c))
                    if have is None:
                        found[t, c] = [1, lo, hi]
                    else:
                        have[:] = have[0] + 1, min(have[1], lo), max(have[2], hi)
                if len(found) > keep:
                    yield rows(found)
                    found = {}
        if found:
            yield rows(found)

    return run


def _held_terms(terms: frozenset[str]):
    """Per term: how many texts hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        of: dict[str, tuple[str, ...]] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                words = set(_PLAIN.findall(text.lower()))
                if len(of) > 500_000:
                    of = {}
                for w in words.difference(of):
                    of[w] = tuple(t for t in _marks(w) if t in terms)
                count.update(set(chain.from_iterable(map(of.__getitem__, words))))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["t", "n"])

    return run


def learn_lexicon(train: DataFrame, least: int = 3, precision: float = 0.9) -> list[str]:
    """The words and word beginnings (ended by ``*``) that mark toxic texts among labelled ones.

    A term counts once per text.  It must stand in ``least`` toxic texts or more, between ``least`` different pairs of words
    and as many as half its texts (all words of copied texts stand between the same ones), and with one text of
    each kind added, ``precision`` of its texts must be toxic.  A beginning is kept if several words share it; words that a beginning covers are left out.
    All such terms come to the driver: no more than the words of the labelled rows, whose number is bounded.
    """
    ship(train.sparkSession)
    each = train.where("y = 1").select("text").mapInArrow(_toxic_terms(), "t string, c long, p long, lo string, hi string")
    each = each.groupBy("t", "c").agg(F.sum("p").alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    stats = each.groupBy("t").agg(F.sum("p").alias("p"), F.count("*").alias("places"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    stats = stats.where((F.col("p") >= least) & (F.col("places") >= least) & (2 * F.col("places") >= F.col("p")) & (~F.col("t").endswith("*") | (F.col("lo") != F.col("hi"))))
    toxic = {r.t: r.p for r in stats.select("t", "p").collect()}
    clean = train.where("y = 0").select("text").mapInArrow(_held_terms(frozenset(toxic)), "t string, n long")
    other = {r.t: r.n for r in clean.groupBy("t").agg(F.sum("n").alias("n")).collect()}
    found = [t for t, p in toxic.items() if (p + 1) / (p + other.get(t, 0) + 2) >= precision * (1 - 1 / (p + 2))]
    kept: set[str] = set()

    def covered(t: str) -> bool:
        return any(t[:k] in kept for k in range(1, len(t) + 1))

    for t in sorted((t[:-1] for t in found if t.endswith("*")), key=len):
        if not covered(t):
            kept.add(t)
    return sorted({t for t in found if not t.endswith("*") and not covered(t)} | {k + "*" for k in kept})


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights and offset of a logistic regression."""
    w = [np.zeros(x.shape[1] + 1)]
    adam, z = Adam(w, rate=0.05, decay=1e-3), np.hstack((x, np.ones((len(x), 1))))
    for _ in range(rounds):
        adam.step([z.T @ (sigmoid(z @ w[0]) - y) / max(1, len(y))])
    return w[0]


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    The lexicon and the weights of its matches are learnt from at most ``rows`` labelled rows that are not held
    out.  Whole texts are scored, words within one edit of a term of five letters or more count as misspelt
    terms, and matches in quotation or report are told from others.  Null texts score as empty ones.
    Without a toxic label nothing is known and all scores are 0.  Repeated rows are scored each; a null doc_id
    stays, with ``held_out`` null; other columns are ignored; an empty table gives an empty one.
    """
    train = materialize(labelled(docs, labels, "toxic", rows), "labelled")
    terms = tuple(learn_lexicon(train))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(terms)
        for b in batches:
            x = [lexicon.features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    ship(docs.sparkSession)
    got = train.select("y", "text").mapInArrow(featured, "y int, x array<double>").toArrow()
    y = np.array(got.column("y").to_pylist(), np.float64)
    x = np.array(got.column("x").to_pylist()).reshape(-1, FEATURES)
    w = fit(x, y) if y.sum() else np.array([0.0] * FEATURES + [-40.0])
    if y.sum():
        # texts without any match keep the base rate of such texts; the offset stays below one half
        w[-1] = min(w[-1], -0.1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(terms)
        for b in batches:
            x = np.array([lexicon.features(t.as_py()) for t in b.column(1)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(x @ w[:-1] + w[-1]), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
