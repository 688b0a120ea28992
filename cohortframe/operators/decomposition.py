"""Leading singular vectors of a sparse observation by gene matrix, and clusters of observations from them.

``expression``: obs, gene, value, each pair once (zeros are not stored; nulls and NaN count as zero).  An observation travels as one sparse row, as
long as it has values.  The driver holds some numbers for every gene and component, never anything per observation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.operators.vectors import nearest_centroid, variable_genes
from cohortframe.plans.ship import ship
from cohortframe.plans.tables import drop, materialize

#: Bytes of a block of directions sent to executors at once; what is wider goes in several passes.
SENT = 128 << 20
#: Values multiplied at once, and genes in a row of a partial product.
_VALUES, _GENES = 1 << 16, 4096
_ADDED = "salt int, block int, sums binary"


@dataclass(frozen=True)
class Decomposition:
    """``values`` fall; ``loadings`` has a row per gene in the order of ``genes`` and a column per component, whose largest element is positive.

    ``means`` and ``variances`` (of the population) are those of the genes; ``residual`` is the largest distance of a component from being
    exact, against the square of the first value.
    """

    genes: list
    n_obs: int
    values: np.ndarray
    loadings: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    centered: bool
    residual: float


@dataclass(frozen=True)
class SparseRows:
    """A shared table (obs, at, x) of sparse rows and what is known of its genes."""

    table: DataFrame
    genes: list
    n_obs: int
    means: np.ndarray
    variances: np.ndarray


def sparse_rows(expression: DataFrame, n_obs: int, observations: DataFrame | None = None, genes: DataFrame | None = None) -> SparseRows:
    """The rows of all ``observations`` (obs), or of those with values, over ``genes`` (gene), or all that occur, in order of their names."""
    x = expression.select("obs", "gene", F.col("value").cast("double").alias("value")).where("value is not null and not isnan(value) and value != 0")
    names = sorted(r[0] for r in (x if genes is None else genes).select("gene").distinct().collect() if r[0] is not None)
    spark, kind = expression.sparkSession, expression.schema["gene"].dataType.simpleString()
    numbered = spark.createDataFrame(list(enumerate(names)), f"at int, gene {kind}")
    rows = x.join(numbered, "gene").groupBy("obs").agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("x"))
    if observations is not None:
        rows = observations.select("obs").distinct().join(rows, "obs", "left")
        rows = rows.select("obs", F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("x", F.array().cast("array<double>")).alias("x"))
    table = materialize(rows, "rows")
    sums, squares = np.zeros(len(names)), np.zeros(len(names))
    each = table.select(F.explode(F.arrays_zip("at", "x")).alias("e")).groupBy("e.at").agg(F.sum("e.x").alias("s"), F.sum(F.col("e.x") * F.col("e.x")).alias("q"))
    for r in each.collect():
        sums[r["at"]], squares[r["at"]] = r["s"], r["q"]
    means = sums / max(n_obs, 1)
    return SparseRows(table, names, n_obs, means, np.maximum(squares / max(n_obs, 1) - means**2, 0.0))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end, genes, values, row of each value) of a batch, some ten thousand values at a time."""
    at, x = batch.column("at"), batch.column("x")
    bounds, genes, values = at.offsets.to_numpy(), at.values.to_numpy(), x.values.to_numpy()
    shift = x.offsets.to_numpy()[0] - bounds[0]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + _VALUES, "right")) - 1)
        a, b = bounds[lo], bounds[hi]
        yield lo, hi, genes[a:b], values[a + shift : b + shift], np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
        lo = hi


def _row_sums(rows: int, row: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Terms added by row; ``row`` rises."""
    out = np.zeros((rows, terms.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] = np.add.reduceat(terms, starts)
    return out


def _multiplied(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        z = np.zeros_like(q)
        for batch in batches:
            for lo, hi, gene, value, row in _parts(batch):
                y = _row_sums(hi - lo, row, value[:, None] * q[gene])
                order = np.argsort(gene, kind="stable")
                z += _row_sums(len(z), gene[order], (value[:, None] * y[row])[order])
        salt = TaskContext.get().partitionId() % 32
        for b, start in enumerate(range(0, len(z), _GENES)):
            yield pa.RecordBatch.from_pydict({"salt": pa.array([salt], pa.int32()), "block": pa.array([b], pa.int32()), "sums": [z[start : start + _GENES].tobytes()]})

    return run


def _added(t: pa.Table) -> pa.Table:
    total = 0.0
    for s in t.column("sums"):
        total = total + np.frombuffer(s.as_py())
    return pa.table({"salt": t.column("salt").slice(0, 1), "block": t.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def _product(rows: SparseRows, q: np.ndarray) -> np.ndarray:
    """A'Aq.  Tasks add up what they read; their sums are added in two steps, so that no group holds one of every task."""
    spark, out = rows.table.sparkSession, []
    step = max(1, SENT // (8 * max(len(q), 1)))
    for c in range(0, q.shape[1], step):
        part = np.ascontiguousarray(q[:, c : c + step])
        sent = spark.sparkContext.broadcast(part)
        sums = rows.table.select("at", "x").mapInArrow(_multiplied(sent), _ADDED).groupBy("salt", "block").applyInArrow(_added, _ADDED).groupBy("block").applyInArrow(_added, _ADDED)
        z = np.zeros_like(part)
        for r in sums.collect():
            z[r["block"] * _GENES : (r["block"] + 1) * _GENES] = np.frombuffer(r["sums"]).reshape(-1, part.shape[1])
        sent.destroy()
        out.append(z)
    return np.hstack(out)


def leading(multiply: Callable[[np.ndarray], np.ndarray], size: int, k: int, seed: int = 7, tolerance: float = 1e-8, extra: int = 8, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, residual): the ``k`` leading eigenvalues of a symmetric positive matrix that is known by its products only.

    A random block of directions is multiplied; what the best vectors within all blocks so far leave over is the next
    block, until nothing above ``tolerance`` is left or the blocks span everything.  Eight blocks are drawn together into four.
    """
    width = min(size, k + extra)
    new = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    basis, image = np.zeros((size, 0)), np.zeros((size, 0))
    for _ in range(rounds):
        basis, image = np.hstack([basis, new]), np.hstack([image, multiply(new)])
        t = basis.T @ image
        w, s = np.linalg.eigh((t + t.T) / 2)
        w, s = w[::-1], s[:, ::-1]
        best = basis @ s[:, :width]
        rest = image @ s[:, :width] - best * w[:width]
        scale = max(w[0], 1e-300)
        residual = float(np.linalg.norm(rest[:, :k], axis=0).max() / scale)
        if residual <= tolerance or basis.shape[1] >= size:
            break
        if basis.shape[1] >= 8 * width:
            basis, image = basis @ s[:, : 4 * width], image @ s[:, : 4 * width]
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        u, d, _ = np.linalg.svd(rest, full_matrices=False)
        new = u[:, d > 1e-12 * scale][:, : size - basis.shape[1]]
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        if not new.shape[1]:
            break
    return np.maximum(w[:k], 0.0), best[:, :k], residual


def truncated_svd(rows: SparseRows, components: int, centered: bool = False, seed: int = 7, tolerance: float = 1e-8) -> Decomposition:
    """The leading singular values and right vectors of the rows; with ``centered``, of the rows less the genes' means.

    There are at most as many components as genes or observations.  Centring changes the products on the driver only, so rows stay sparse.
    """
    ship(rows.table.sparkSession)
    k = max(0, min(components, len(rows.genes), rows.n_obs))
    if not k:
        return Decomposition(rows.genes, rows.n_obs, np.zeros(0), np.zeros((len(rows.genes), 0)), rows.means, rows.variances, centered, 0.0)

    def multiply(q: np.ndarray) -> np.ndarray:
        z = _product(rows, q)
        return z - rows.n_obs * np.outer(rows.means, rows.means @ q) if centered else z

    squares, v, residual = leading(multiply, len(rows.genes), k, seed, tolerance)
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return Decomposition(rows.genes, rows.n_obs, np.sqrt(squares), v, rows.means, rows.variances, centered, residual)


def scores(rows: SparseRows, svd: Decomposition) -> DataFrame:
    """(obs, vector): each row times the loadings, less the means' if the decomposition is centred."""
    spark, k = rows.table.sparkSession, len(svd.values)
    ship(spark)
    sent, less = spark.sparkContext.broadcast(np.ascontiguousarray(svd.loadings)), svd.means @ svd.loadings if svd.centered else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in batches:
            for lo, hi, gene, value, row in _parts(batch):
                y = _row_sums(hi - lo, row, value[:, None] * v[gene]) - less
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * k, pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("obs").slice(lo, hi - lo), vectors], names=["obs", "vector"])

    kind = rows.table.schema["obs"].dataType.simpleString()
    return rows.table.mapInArrow(run, f"obs {kind}, vector array<double>")


def vector_clusters(vectors: DataFrame, clusters: int, seed: int = 7, starts: int = 3) -> DataFrame:
    """(obs, cluster): k-means of (obs, vector), the best of ``starts`` seeds by the sum of squared distances; numbers follow the order of the centers."""
    points = vectors.select(array_to_vector("vector").alias("features"))
    models = [KMeans(k=clusters, seed=seed + i, initMode="k-means||", maxIter=100).fit(points) for i in range(starts)]
    centers = sorted([float(x) for x in c] for c in min(models, key=lambda m: m.summary.trainingCost).clusterCenters())
    table = vectors.sparkSession.createDataFrame(list(enumerate(centers)), "centroid_id int, centroid array<double>")
    return nearest_centroid(vectors, table).select("obs", F.col("centroid_id").alias("cluster"))


def basic_clusters(expression: DataFrame, observations: DataFrame, top: int = 1024, components: int = 20, seed: int = 7) -> DataFrame:
    """(obs, cluster) of every observation: k-means of its scores on the leading singular vectors of the ``top`` most variable genes.

    Two to eight clusters, more of them the more observations there are: the root of a 350th of their number, plus two.  Fewer than two genes, or
    than three observations, make one cluster.  Genes of equal variance are taken by name.
    """
    observations = observations.select("obs").distinct()
    n = observations.count()
    rows = sparse_rows(expression, n, observations, variable_genes(expression, max(n, 1), top))
    k = min(components, n - 1, len(rows.genes) - 1)
    if n < 3 or len(rows.genes) < 2:
        return rows.table.select("obs", F.lit(0).alias("cluster"))
    vectors = materialize(scores(rows, truncated_svd(rows, max(2, k), seed=seed)), "scores")
    drop(rows.table)
    return vector_clusters(vectors, int(max(2, min(8, (n / 350.0) ** 0.5 + 2))), seed)


def fill_clusters(observations: DataFrame, expression: DataFrame) -> DataFrame:
    """``observations`` (obs, cluster, ...) as they are if all name a cluster; if any is null or empty, all get ``cluster_0``, ... of :func:`basic_clusters`."""
    if observations.where("cluster is null or cluster = ''").isEmpty():
        return observations
    found = basic_clusters(expression, observations).select("obs", F.format_string("cluster_%d", "cluster").alias("cluster"))
    return observations.drop("cluster").join(found, "obs").select(*observations.columns)
