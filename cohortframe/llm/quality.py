"""Quality classifier by positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.classify import Adam, Network, drawn, held_out, labelled, sigmoid
from cohortframe.llm.common import give_back, materialize
from cohortframe.plans.ship import ship

#: Bytes by kind: lower, upper, digit, blank, stop, mark, bracket or sign, other ASCII, above ASCII.
_KIND = np.full(256, 7)
_KIND[128:] = 8
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:", b"!?", b"|#$%&*@^~=+<>{}[]()/\\_-")):
    _KIND[list(_set)] = _k
_SHARES = 9
WIDTH = _SHARES + 13 + 24


def features(text: bytes) -> np.ndarray:
    """Numbers that describe a text's form: byte kinds, word lengths, repetition, lines and word endings."""
    out = np.zeros(WIDTH)
    data = np.frombuffer(text, np.uint8)
    words = text.split()
    n = len(words)
    out[:_SHARES] = np.bincount(_KIND[data], minlength=_SHARES) / max(1, len(data))
    lines = [x for x in text.split(b"\n") if x]
    size = np.fromiter(map(len, words), np.int64, n)
    low = [w.lower() for w in words]
    kinds = set(low)
    own = out[_SHARES : _SHARES + 13]
    own[0], own[1] = np.log1p(n), np.log1p(len(lines))
    if n:
        own[2], own[3], own[4] = size.mean(), size.std(), min(size.max(), 60)
        own[5] = len(kinds) / n
        own[6] = len(kinds) / n**0.7
        own[7] = sum(a == b for a, b in zip(low, low[1:])) / n
        own[8] = len(set(zip(low, low[1:]))) / n
        own[9] = sum(map(bytes.isupper, words)) / n
        own[10] = sum(map(bytes.istitle, words)) / n
        own[11] = len(set(lines)) / max(1, len(lines))
        own[12] = np.mean([len(x) for x in lines]) / 100 if lines else 0
        ends = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
        firsts = np.frombuffer(b"".join(w[:1] for w in words), np.uint8)
        out[_SHARES + 13 : _SHARES + 22] = np.bincount(_KIND[ends], minlength=9) / n
        out[_SHARES + 22 : _SHARES + 31] = np.bincount(_KIND[firsts], minlength=9) / n
        for j, w in enumerate((b"the", b"de", b"der", b"la", b"und", b"que")):
            out[_SHARES + 31 + j] = low.count(w) / n
    return out


def risk_gradients(net: Network, zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[list[np.ndarray], float]:
    """The step's gradients on positive and unlabelled inputs, and the estimated risk of the negatives.

    Of prior * R_p(+) + R_u(-) - prior * R_p(-) with the sigmoid loss, loss(+) = sigmoid(-g), loss(-) = sigmoid(g); where the
    part of the negatives is below zero, of that part alone, uphill.
    """
    hu, gu = net._forward(zu)
    hp, gp = net._forward(zp)
    su, sp = sigmoid(gu), sigmoid(gp)
    du, dp = su * (1 - su) / len(gu), sp * (1 - sp) / len(gp)
    negative = float(su.mean() - prior * sp.mean())
    of_u = net.gradients(zu, hu, du)
    if negative >= 0:
        return [a + b for a, b in zip(of_u, net.gradients(zp, hp, -2 * prior * dp), strict=True)], negative
    return [b - a for a, b in zip(of_u, net.gradients(zp, hp, prior * dp), strict=True)], negative


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, rounds: int = 60, batch: int = 512, seed: int = 7) -> Network:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), with the sigmoid loss.

    Where the estimated risk of the negatives falls below zero, the step goes uphill on that part
    instead, which keeps the network from learning the positives by heart.
    """
    net = Network(positive.shape[1], hidden, seed)
    net.fit_scale(unlabelled)
    p, u = net._in(positive), net._in(unlabelled)
    r, adam = np.random.default_rng(seed), Adam(net.w)
    steps = max(1, len(u) // batch)
    for _ in range(rounds):
        up = r.permutation(len(u))
        for k in range(steps):
            zu, zp = u[up[k * batch : (k + 1) * batch]], p[r.integers(0, len(p), batch)]
            adam.step(risk_gradients(net, zp, zu, prior)[0])
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7, rounds: int = 300, risk: float = 0.1) -> float:
    """The share of positives among the unlabelled texts, from trusted positives and unlabelled ones alone.

    A logistic regression tells positives from unlabelled texts on one half of each.  On the other half, the share of
    unlabelled texts above a threshold is at least the prior times the share of positives above it, and about that
    where only positives are left; so the prior is the ratio of both shares at the threshold whose upper
    confidence bound is least.  Kept off both ends.
    """
    r = np.random.default_rng(seed)
    p, u = positive[r.permutation(len(positive))], unlabelled[r.permutation(len(unlabelled))]
    if min(len(p), len(u)) < 4:
        return 0.5
    mean, scale = u.mean(0), np.maximum(u.std(0), 1e-6)
    p, u = ((np.hstack((np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))))) for x in (p, u))
    fit_p, fit_u, p, u = p[::2], u[::2], p[1::2], u[1::2]
    w = [np.zeros(p.shape[1])]
    adam = Adam(w, rate=0.03, decay=1e-3)
    for _ in range(rounds):
        adam.step([fit_u.T @ sigmoid(fit_u @ w[0]) / len(fit_u) - fit_p.T @ (1 - sigmoid(fit_p @ w[0])) / len(fit_p)])
    gp, gu = np.sort(p @ w[0]), np.sort(u @ w[0])
    above_p = np.arange(len(gp), 0, -1) / len(gp)
    above_u = 1 - np.searchsorted(gu, gp, "left") / len(gu)
    slack = np.sqrt(np.log(4 / risk) / 2 / len(gp)) + np.sqrt(np.log(4 / risk) / 2 / len(gu))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def _featured(df: DataFrame) -> DataFrame:
    """Every column but text, and the features."""
    names = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py().encode()) for t in b.column("text")]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(list(x), pa.list_(pa.float64()))], [*names, "x"])

    ship(df.sparkSession)
    return df.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in df.dtypes if c != "text"), "x array<double>"]))


def _collected(df: DataFrame) -> np.ndarray:
    """The features of a bounded table, in an order of their own, so that a fit does not depend on partitions."""
    x = np.array(df.select("x").toArrow().column("x").to_pylist(), np.float64).reshape(-1, WIDTH)
    return x[np.lexsort(x.T[::-1])]


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000, unlabelled_rows: int = 20_000) -> tuple[Network, float] | None:
    """A network from trusted positives and unlabelled texts, and the class prior; None where there are no positives.

    ``rows`` bounds the labelled rows that the fit takes, ``unlabelled_rows``, in the mean, the unlabelled ones.  Labels only choose the positives.
    The unlabelled rows are drawn by a hash of (doc_id, text) from all different rows that are not held out.
    """
    x = _collected(_featured(labelled(docs, labels, "quality", rows)).where("y = 1"))
    if not len(x):
        return None
    free = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where(~held_out())
    u = _collected(_featured(drawn(free, unlabelled_rows / max(1, free.count()), "doc_id", "text")))
    u = u if len(u) else x
    prior = estimate_prior(x, u)
    return fit_pu(x, u, prior), prior


def quality_rows(docs: DataFrame, labels: DataFrame, rows: int = 20_000, accept: float = 0.3, unlabelled_rows: int = 20_000) -> DataFrame:
    """(doc_id, text_key, held_out, score, predicted) for every row of ``docs``; ``text_key`` is a hash of the text.

    ``score`` is 0 to 1, higher for texts like the trusted ones; ``predicted`` is 1 from ``accept`` on.  Only form
    features of the text are inputs.  The network's outputs are shifted so that as large a share of all texts that are not
    held out is accepted as the class prior says.  Null texts score as empty ones.  Without any positive label
    all scores are 0.5.  Repeated rows are scored each; a null doc_id stays, with ``held_out`` null; other columns are
    ignored; an empty table gives an empty one.
    """
    fitted = train(docs, labels, rows, unlabelled_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py().encode()) for t in b.column(2)]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fitted[0].logit(x) if fitted else np.zeros(len(x)), pa.float64())], ["doc_id", "text_key", "g"])
        give_back()

    ship(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, text_key long, g double")
    shift = 0.0
    if fitted:
        out = materialize(out, "logits")
        cut = out.where(~held_out()).agg(F.percentile_approx("g", 1 - fitted[1], 100_000)).first()[0]
        shift = float(np.log(accept / (1 - accept))) - (cut or 0.0)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("g") + shift))))
    return out.select("doc_id", "text_key", held_out().alias("held_out"), score.alias("score"), (score >= accept).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = 20_000, accept: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``: :func:`quality_rows` without the hash."""
    return quality_rows(docs, labels, rows, accept).drop("text_key")
