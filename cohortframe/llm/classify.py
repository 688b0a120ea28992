"""What both text classifiers need: labelled rows, bounded samples and a small network."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out() -> Column:
    """crc32 of the doc_id's digits is a multiple of five; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def drawn(rows: DataFrame, share: float, *columns: str) -> DataFrame:
    """About ``share`` of the different rows by ``columns``, by their hash: the same ones however the table is dealt out."""
    h = F.pmod(F.xxhash64(*columns, F.lit(7)), F.lit(1 << 40))
    return rows.where(h < int(min(1.0, share) * (1 << 40))).dropDuplicates(list(columns))


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, text, y): at most ``rows`` labels that are not held out, the smallest by a hash of doc_id, on about twice as many rows at most.

    The sample is drawn among labels before texts are read, so its bound is also the bound
    of what is joined.  Repeated rows count once; it does not depend on partitions.
    """
    some = labels.select("doc_id", F.col(column).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    some = some.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(column)), "doc_id").limit(rows)
    some = F.broadcast(some) if rows <= broadcast_rows else some
    # a doc_id may stand on many rows: then a share of them is drawn
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = own.select("doc_id").join(some, "doc_id").count()
    return drawn(own.join(some, "doc_id"), 2 * rows / max(n, 1), "doc_id", "text")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Standardised inputs, one hidden layer, one output."""

    def __init__(self, width: int, hidden: int, seed: int) -> None:
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w = [r.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def fit_scale(self, x: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)

    def _in(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.w[0] + self.w[1])
        return h, h @ self.w[2] + self.w[3][0]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._forward(self._in(x))[1]

    def gradients(self, z: np.ndarray, h: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Of the weights, from the slope of the loss at each output."""
        back = np.outer(slope, self.w[2]) * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()])]


class Adam:
    def __init__(self, w: list[np.ndarray], rate: float = 3e-3, decay: float = 1e-4) -> None:
        self.w, self.rate, self.decay, self.t = w, rate, decay, 0
        self.m, self.v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]

    def step(self, g: list[np.ndarray]) -> None:
        self.t += 1
        for i, x in enumerate(g):
            x = x + self.decay * self.w[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * x
            self.v[i] = 0.999 * self.v[i] + 0.001 * x * x
            self.w[i] -= self.rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)
