"""Contrastive embedding of graph nodes: a two-layer neighbourhood encoder fitted by batches of neighbourhoods.

Each batch holds some nodes, its seeds, with all that lies within three steps of them, so a task computes the loss of a batch and
its gradient alone.  A round reads every batch once; tasks add their gradients up, and one vector as long as the
parameters comes to the driver, which takes the step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import erf, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.plans.ship import ship
from cohortframe.plans.tables import materialize


@dataclass(frozen=True)
class Settings:
    """Widths, strengths of the augmentations, weights of the parts of the loss, and how steps are taken."""

    hidden: int = 80
    width: int = 24
    dropout: float = 0.10
    feature_dropout: float = 0.18
    edge_dropout: float = 0.12
    mask: float = 0.08
    noise: float = 0.025
    temperature: float = 0.20
    rounds: int = 48
    rate: float = 3e-3
    decay: float = 1e-4
    clip: float = 5.0
    patience: int = 10
    least_gain: float = 1e-4
    neighbor_weight: float = 0.35
    balance_weight: float = 0.18
    spread_weight: float = 0.05
    seed: int = 7


# --- the encoder -------------------------------------------------------------------------------

_GRID = np.linspace(-6.0, 6.0, 6001)
_ERF = np.array([erf(x) for x in _GRID])
_SLOPE = 2 / sqrt(pi) * np.exp(-_GRID * _GRID)


#: By grid piece, the four coefficients of the cubic in the place within the piece.
_STEP = float(_GRID[1] - _GRID[0])
_RISE, _S0, _S1 = _ERF[1:] - _ERF[:-1], _STEP * _SLOPE[:-1], _STEP * _SLOPE[1:]
_CUBIC = np.stack([_ERF[:-1], _S0, 3 * _RISE - 2 * _S0 - _S1, _S0 + _S1 - 2 * _RISE], 1)


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function by cubic pieces over a grid of exact values and slopes."""
    t = np.clip(x, -6.0, 6.0)
    t += 6.0
    t /= _STEP
    i = np.minimum(t.astype(np.intp), len(_CUBIC) - 1)
    t -= i
    c = _CUBIC.take(i, 0)
    out = c[..., 3] * t
    for k in (2, 1):
        out += c[..., k]
        out *= t
    out += c[..., 0]
    return out


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value and the slope of x times the normal distribution function."""
    share = 0.5 * (1 + _erf(x / sqrt(2)))
    return x * share, share + x * np.exp(-0.5 * x * x) / sqrt(2 * pi)


def shapes(features: int, s: Settings) -> list[tuple[int, ...]]:
    """Weights and offsets of three layers; scale and shift of two normalisations."""
    h, w = s.hidden, s.width
    return [(features, h), (h,), (h, h), (h,), (h, w), (w,), (h,), (h,), (h,), (h,)]


def first_parameters(features: int, s: Settings) -> np.ndarray:
    """Uniform within one over the root of a layer's inputs; scales are one and shifts zero."""
    rng, out, inputs = np.random.default_rng(s.seed), [], 1
    for i, shape in enumerate(shapes(features, s)):
        if i >= 6:
            out.append(np.full(shape, 1.0 - i % 2))
            continue
        inputs = shape[0] if i % 2 == 0 else inputs
        out.append(rng.uniform(-1 / sqrt(inputs), 1 / sqrt(inputs), shape))
    return np.concatenate([p.ravel() for p in out])


def _split(flat: np.ndarray, features: int, s: Settings) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes(features, s):
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


class Adjacency:
    """Weighted edges between the ``n`` nodes of a batch, by rows."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int) -> None:
        self.n, self.parts = n, (src, dst, weight)
        self.ways = [self._sorted(src, dst, weight), self._sorted(dst, src, weight)]

    @staticmethod
    def _sorted(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple:
        order = np.argsort(a, kind="stable")
        rows, starts, n = np.unique(a[order], return_index=True, return_counts=True)
        other, weight = b[order], weight[order, None]
        if len(n) and n.max() > 32:
            return rows, starts, other, weight
        # the first edges of all rows, then the second ones, and so on: few gathers where degrees are small
        return tuple((rows[n > j], other[starts[n > j] + j], weight[starts[n > j] + j]) for j in range(n.max() if len(n) else 0))

    def times(self, x: np.ndarray, transposed: bool = False) -> np.ndarray:
        way, out = self.ways[transposed], np.zeros((self.n, x.shape[1]))
        if way and isinstance(way[0], tuple):
            for rows, other, weight in way:
                near = x[other]
                near *= weight
                out[rows] += near
        elif way:
            rows, starts, other, weight = way
            out[rows] = np.add.reduceat(weight * x[other], starts)
        return out

    def thinned(self, share: float, rng: np.random.Generator) -> Adjacency:
        """Without a share of the edges; the weights left of a row sum to one again."""
        src, dst, weight = self.parts
        if share <= 0:
            return self
        kept = weight * (rng.random(len(weight)) >= share)
        kept = kept / np.maximum(np.bincount(src, kept, self.n), 1e-6)[src]
        on = kept > 0
        return Adjacency(src[on], dst[on], kept[on], self.n)


def _norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray):
    c = x - x.mean(1, keepdims=True)
    r = 1 / np.sqrt((c * c).mean(1, keepdims=True) + 1e-5)
    return c * r * scale + shift, (c * r, r)


def _norm_back(g: np.ndarray, kept, scale: np.ndarray):
    y, r = kept
    d = g * scale
    return r * (d - d.mean(1, keepdims=True) - y * (d * y).mean(1, keepdims=True)), (g * y).sum(0), g.sum(0)


def encode(x: np.ndarray, near: Adjacency, p: list[np.ndarray], keeps: list[np.ndarray] | None = None):
    """Unit embeddings of all nodes, and what :func:`encode_back` needs; ``keeps`` multiply the three layers' inputs."""
    w1, b1, w2, b2, w3, b3, s1, t1, s2, t2 = p
    keeps = keeps or [np.ones(1)] * 3
    x1 = x * keeps[0]
    g1, k1 = _gelu(x1 @ w1 + b1)
    n1, m1 = _norm(g1 + near.times(g1), s1, t1)
    x2 = n1 * keeps[1]
    g2, k2 = _gelu(x2 @ w2 + b2)
    n2, m2 = _norm(g2 + near.times(g2), s2, t2)
    x3 = n2 * keeps[2]
    e = x3 @ w3 + b3
    size = np.maximum(np.sqrt((e * e).sum(1, keepdims=True)), 1e-12)
    return e / size, (x1, k1, m1, x2, k2, m2, x3, e / size, size, keeps)


def encode_back(g: np.ndarray, near: Adjacency, p: list[np.ndarray], kept) -> np.ndarray:
    """The gradient by parameters of a loss whose gradient by embeddings is ``g``."""
    _, _, w2, _, w3, _, s1, _, s2, _ = p
    x1, k1, m1, x2, k2, m2, x3, z, size, keeps = kept
    g = (g - z * (g * z).sum(1, keepdims=True)) / size
    dw3, db3 = x3.T @ g, g.sum(0)
    g, ds2, dt2 = _norm_back(g @ w3.T * keeps[2], m2, s2)
    g = (g + near.times(g, True)) * k2
    dw2, db2 = x2.T @ g, g.sum(0)
    g, ds1, dt1 = _norm_back(g @ w2.T * keeps[1], m1, s1)
    g = (g + near.times(g, True)) * k1
    return np.concatenate([d.ravel() for d in (x1.T @ g, g.sum(0), dw2, db2, dw3, db3, ds1, dt1, ds2, dt2)])


# --- the loss ------------------------------------------------------------------------------------


def contrast(a: np.ndarray, b: np.ndarray, temperature: float):
    """Cross entropy of telling each row's own other view from those of the rest, both ways; gradients by ``a`` and ``b``."""
    logits, n, loss, g = a @ b.T / temperature, len(a), 0.0, 0.0
    for x, back in ((logits, False), (logits.T, True)):
        e = np.exp(x - x.max(1, keepdims=True))
        q = e / e.sum(1, keepdims=True)
        loss -= 0.5 * np.log(np.maximum(np.diagonal(q), 1e-300)).mean()
        d = 0.5 * (q - np.eye(n)) / n
        g = g + (d.T if back else d)
    return float(loss), g @ b / temperature, g.T @ a / temperature


def neighbor_loss(z: np.ndarray, near: Adjacency, seeds: np.ndarray):
    """One less the mean cosine of seeds to the mean of their neighbours, and its gradient by all embeddings."""
    m = near.times(z)[seeds]
    size = np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)
    u, own = m / size, z[seeds]
    cos = (own * u).sum(1, keepdims=True)
    g, by_mean = np.zeros_like(z), np.zeros_like(z)
    by_mean[seeds] = -(own - cos * u) / size / len(seeds)
    g[seeds] = -u / len(seeds)
    return float(1 - cos.mean()), g + near.times(by_mean, True)


def _centers(z: np.ndarray, codes: np.ndarray):
    names, at = np.unique(codes, return_inverse=True)
    share = np.zeros((len(names), len(z)))
    share[at, np.arange(len(z))] = 1
    share /= share.sum(1, keepdims=True)
    return names, share @ z, share


def balance_loss(z: np.ndarray, samples: np.ndarray, conditions: np.ndarray):
    """The mean squared distance of samples' centers to the mean center of their condition (a sample's commonest; ties: the first)."""
    names, c, share = _centers(z, samples)
    if len(names) < 2:
        return 0.0, np.zeros_like(z)
    own = []
    for name in names:
        found, n = np.unique(conditions[samples == name], return_counts=True)
        own.append(found[n.argmax()])
    own = np.array(own)
    off = c - np.array([c[own == k].mean(0) for k in own])
    return float((off * off).sum(1).mean()), share.T @ (2 * off / len(names))


def spread(z: np.ndarray, conditions: np.ndarray):
    """The mean distance between the centers of conditions."""
    names, c, share = _centers(z, conditions)
    n = len(names)
    if n < 2:
        return 0.0, np.zeros_like(z)
    off = c[:, None] - c[None]
    far = np.sqrt((off * off).sum(2))
    g = (off / np.maximum(far, 1e-12)[:, :, None]).sum(1) * 2 / (n * (n - 1))
    return float(far.sum() / (n * (n - 1))), share.T @ g


PARTS = ("total_loss", "contrastive_loss", "neighbor_loss", "sample_balance_loss", "condition_spread_bonus")


@dataclass
class Batch:
    """Nodes with features, edges among them, and which of them are seeds."""

    name: int
    x: np.ndarray
    near: Adjacency
    seeds: np.ndarray
    samples: np.ndarray
    conditions: np.ndarray


def _view(b: Batch, s: Settings, turn: int, view: int):
    """One augmented view: features, edges, and what dropout keeps.  Columns are left out alike in all batches of a round."""
    columns = np.random.default_rng((s.seed, turn, view)).random(b.x.shape[1]) >= s.feature_dropout
    rng = np.random.default_rng((s.seed, turn, view, b.name & 0xFFFFFFFF))
    near = b.near.thinned(s.edge_dropout, rng)
    x = b.x * columns / max(columns.mean(), 1e-3) + s.noise * rng.standard_normal(b.x.shape)
    masked = rng.random(len(x)) < s.mask
    x = np.where(masked[:, None], 0.5 * x + 0.5 * near.times(x), x)
    keeps = [(rng.random((len(x), w)) >= s.dropout) / (1 - s.dropout) for w in (x.shape[1], s.hidden, s.hidden)]
    return x, near, keeps


def batch_loss(flat: np.ndarray, b: Batch, s: Settings, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the loss over the seeds of a batch, named in :data:`PARTS`, and the gradient of the total."""
    p = _split(flat, b.x.shape[1], s)
    views = [_view(b, s, turn, k) for k in (1, 2)]
    (z1, kept1), (z2, kept2) = (encode(*v[:2], p, v[2]) for v in views)
    out = np.zeros(5)
    grads = [np.zeros_like(z1), np.zeros_like(z2)]
    out[1], c1, c2 = contrast(z1[b.seeds], z2[b.seeds], s.temperature)
    grads[0][b.seeds] += c1
    grads[1][b.seeds] += c2
    for g, z in zip(grads, (z1, z2), strict=True):
        loss, d = neighbor_loss(z, b.near, b.seeds)
        out[2] += 0.5 * loss
        g += 0.5 * s.neighbor_weight * d
        loss, d = balance_loss(z[b.seeds], b.samples, b.conditions)
        out[3] += 0.5 * loss
        g[b.seeds] += 0.5 * s.balance_weight * d
    out[4], d = spread(0.5 * (z1 + z2)[b.seeds], b.conditions)
    for g in grads:
        g[b.seeds] -= 0.5 * s.spread_weight * d
    out[0] = out[1] + s.neighbor_weight * out[2] + s.balance_weight * out[3] - s.spread_weight * out[4]
    return out, sum(encode_back(g, v[1], p, k) for g, v, k in zip(grads, views, (kept1, kept2), strict=True))


# --- batches on the cluster ------------------------------------------------------------------------


def _standardised(nodes: DataFrame) -> DataFrame:
    """Features centred and scaled over all nodes; what is not finite is zero, deviations up to 1e-6 count as one."""
    clean = nodes.withColumn("x", F.transform("features", lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v.cast("double"))))
    stat = clean.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))
    stat = stat.agg(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("d") > 1e-6, F.col("d")).otherwise(1.0).alias("d")))).alias("_stat"))
    # one row with as many numbers as a node has features
    return clean.crossJoin(F.broadcast(stat)).withColumn("x", F.zip_with("x", "_stat", lambda v, t: (v - t["m"]) / t["d"])).drop("_stat", "features")


def neighborhoods(nodes: DataFrame, edges: DataFrame, batch_nodes: int = 256, steps: int = 3) -> DataFrame:
    """(batch, nodes, edges): about ``batch_nodes`` seeds each, with all nodes within ``steps`` edges and the edges from those within ``steps - 1``.

    Every node is a seed once; hashes of (sample_id, obs_id) deal seeds out.  A batch holds at most
    ``batch_nodes`` times degree ** ``steps`` nodes, so the number of edges from a node must be bounded, as the nearest neighbours are.
    """
    n = max(1, -(-nodes.count() // batch_nodes))
    key = ["sample_id", "obs_id"]
    x = _standardised(nodes.select(*key, "condition", "features"))
    e = edges.select("sample_id", F.col("src").alias("obs_id"), "dst", F.col("weight").cast("double").alias("weight"))
    seeds = nodes.select(F.pmod(F.xxhash64(*key), F.lit(n)).alias("batch"), *key, F.lit(0).alias("step"))
    near = seeds
    for k in range(steps):
        further = near.where(F.col("step") == k).join(e, key).select("batch", "sample_id", F.col("dst").alias("obs_id"), F.lit(k + 1).alias("step"))
        near = materialize(near.unionByName(further).groupBy("batch", *key).agg(F.min("step").alias("step")), "near")
    inside = near.join(x, key).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("sample_id", "obs_id", "step", "condition", "x"))).alias("nodes"))
    links = near.where(F.col("step") < steps).join(e, key).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("sample_id", F.col("obs_id").alias("src"), "dst", "weight"))).alias("edges"))
    return materialize(inside.join(links, "batch", "left"), "batches")


def _name(batch: int) -> int:
    return int.from_bytes(hashlib.sha256(str(batch).encode()).digest()[:4], "little")


def _read(row: dict) -> tuple[Batch, list[dict]]:
    nodes, edges = row["nodes"], row["edges"] or []
    at = {(r["sample_id"], r["obs_id"]): i for i, r in enumerate(nodes)}
    src, dst = (np.array([at[r["sample_id"], r[c]] for r in edges], np.int64) for c in ("src", "dst"))
    near = Adjacency(src, dst, np.array([r["weight"] for r in edges], float), len(nodes))
    seeds = np.array([i for i, r in enumerate(nodes) if r["step"] == 0], np.int64)
    samples, conditions = (np.array([str(nodes[i][c]) for i in seeds]) for c in ("sample_id", "condition"))
    return Batch(_name(row["batch"]), np.array([r["x"] for r in nodes], float), near, seeds, samples, conditions), nodes


_PACKED = "batch long, n long, seeds binary, x binary, src binary, dst binary, weight binary, samples array<string>, conditions array<string>"


def packed(batches: DataFrame) -> DataFrame:
    """The batches of :func:`neighborhoods` as arrays, so that a round reads numbers instead of looking nodes up again."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                own, _ = _read(row)
                src, dst, weight = own.near.parts
                values = {"batch": row["batch"], "n": len(own.x), "seeds": own.seeds.tobytes(), "x": own.x.tobytes(), "src": src.tobytes(), "dst": dst.tobytes(), "weight": weight.tobytes(), "samples": own.samples.tolist(), "conditions": own.conditions.tolist()}
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) if isinstance(v, bytes) else pa.array([v]) for v in values.values()], list(values))

    return materialize(batches.mapInArrow(run, _PACKED), "packed")


def _unpacked(row: dict) -> Batch:
    """The batch of a row of :func:`packed`."""
    seeds, src, dst = (np.frombuffer(row[c], np.int64) for c in ("seeds", "src", "dst"))
    near = Adjacency(src, dst, np.frombuffer(row["weight"]), row["n"])
    return Batch(_name(row["batch"]), np.frombuffer(row["x"]).reshape(row["n"], -1), near, seeds, np.array(row["samples"]), np.array(row["conditions"]))


def total_loss(batches: DataFrame, flat: np.ndarray, s: Settings, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """The loss and the gradient over all batches, as they are or :func:`packed`, weighted by their seeds.

    A task gives one number per parameter, summed up by place on the executors.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weight = 0.0, 0
        for b in rows:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                batch = _unpacked(row) if "x" in row else _read(row)[0]
                parts, gradient = batch_loss(flat, batch, s, turn)
                sums, weight = sums + len(batch.seeds) * np.concatenate((parts, gradient)), weight + len(batch.seeds)
        if weight:
            v = np.append(sums, float(weight))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], ["i", "v"])

    got = batches.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
    return got[:5] / got[-1], got[5:-1] / got[-1]


def fit(batches: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, list[dict[str, float]]]:
    """The parameters of the round with the least loss, and the parts of the loss by round.

    Steps have decaying weights and bounded gradients; fitting ends after ``patience`` rounds without gain.
    """
    ship(batches.sparkSession)
    width = F.octet_length("x") / 8 / F.col("n") if "x" in batches.columns else F.size(F.col("nodes")[0]["x"])
    first = batches.select(width.cast("int").alias("d")).first()
    if first is None:
        return np.zeros(0), []
    flat = first_parameters(first["d"], s)
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    best, least, idle, history = flat, np.inf, 0, []
    for turn in range(1, s.rounds + 1):
        parts, g = total_loss(batches, flat, s, turn)
        g = g * min(1.0, s.clip / (float(np.sqrt(g @ g)) + 1e-6))
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        flat = flat * (1 - s.rate * s.decay) - s.rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
        history.append({"round": turn} | dict(zip(PARTS, parts.tolist(), strict=True)))
        if parts[0] + s.least_gain < least:
            best, least, idle = flat, float(parts[0]), 0
        else:
            idle += 1
            if idle >= s.patience:
                break
    return best, history


def embed(batches: DataFrame, flat: np.ndarray, s: Settings = Settings(), obs_type: str = "long") -> DataFrame:
    """(sample_id, obs_id, embedding): each seed's unit vector, without augmentation."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for k in range(b.num_rows):
                batch, nodes = _read(b.slice(k, 1).to_pylist()[0])
                z, _ = encode(batch.x, batch.near, _split(flat, batch.x.shape[1], s))
                own = [nodes[i] for i in batch.seeds]
                yield pa.RecordBatch.from_arrays([pa.array([str(r["sample_id"]) for r in own], pa.string()), pa.array([r["obs_id"] for r in own]), pa.array(z[batch.seeds].tolist(), pa.list_(pa.float64()))], ["sample_id", "obs_id", "embedding"])

    return batches.mapInArrow(run, f"sample_id string, obs_id {obs_type}, embedding array<double>")


def graph_embedding(nodes: DataFrame, edges: DataFrame, s: Settings = Settings(), batch_nodes: int = 256) -> tuple[DataFrame, list[dict[str, float]]]:
    """Embeddings of all nodes (sample_id, obs_id, embedding), and the loss by round.

    ``nodes``: sample_id, obs_id, condition, features (arrays of one length); ``edges``: sample_id, src, dst, weight, weights of a node
    summing to one.  Contrast, balance of samples and spread of conditions are those among the seeds of a batch; with one batch
    they are those of the whole graph.  Nodes without edges have no neighbours to take after; a null sample_id, obs_id or
    features drops the node; repeated nodes count once; edges to unknown nodes are left out.
    """
    key = ["sample_id", "obs_id"]
    nodes = nodes.where("sample_id is not null and obs_id is not null and features is not null").dropDuplicates(key)
    known = nodes.select("sample_id", F.col("obs_id").alias("dst"))
    batches = neighborhoods(nodes, edges.join(known, ["sample_id", "dst"], "left_semi"), batch_nodes)
    flat, history = fit(packed(batches), s)
    return embed(batches, flat, s, nodes.schema["obs_id"].dataType.simpleString()), history
