"""What clustering rests on: moments summed by group, the index of a clustering, and the choice of a number of clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.plans.ship import ship
from cohortframe.plans.tables import drop, materialize


def calinski_harabasz(rows: DataFrame, label: str, vector: str = "vector") -> DataFrame:
    """One row: (n, clusters, between, within, calinski_harabasz) of the clustering that ``label`` gives; null for fewer than two clusters or one a row.

    Between and within are sums of squared distances from cluster means to the mean and from rows to their cluster's mean, both
    from sums per cluster and element; a clustering without any distance within scores 1.
    """
    each = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("c"), F.posexplode(vector).alias("i", "v"))
    part = each.groupBy("c", "i").agg(F.count("*").alias("m"), F.sum("v").alias("s"), F.var_pop("v").alias("var"))
    means = part.groupBy("i").agg(F.sum("m").alias("n"), (F.sum("s") / F.sum("m")).alias("mean"))
    sums = part.join(F.broadcast(means), "i").agg(
        F.max("n").alias("n"), F.count_distinct("c").alias("clusters"), F.sum(F.col("m") * F.pow(F.col("s") / F.col("m") - F.col("mean"), F.lit(2.0))).alias("between"), F.sum(F.col("m") * F.col("var")).alias("within"),
    )
    index = F.when(F.col("within") == 0, 1.0).otherwise(F.col("between") * (F.col("n") - F.col("clusters")) / (F.col("within") * (F.col("clusters") - 1)))
    return sums.withColumn("calinski_harabasz", F.when((F.col("clusters") > 1) & (F.col("clusters") < F.col("n")), index))


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centers * centers).sum(1) - 2 * x @ centers.T, 0.0)


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(centers, label of each row, sum of squared distances) from seeds drawn by squared distance; an empty cluster keeps its center."""
    r = np.random.default_rng(seed)
    centers = x[r.integers(len(x))][None]
    near = squared(x, centers)[:, 0]
    while len(centers) < k:
        total = near.sum()
        at = int(np.searchsorted(np.cumsum(near), r.random() * total, "right")) if total > 0 else int(r.integers(len(x)))
        centers = np.vstack((centers, x[min(at, len(x) - 1)]))
        near = np.minimum(near, squared(x, centers[-1:])[:, 0])
    label = None
    for _ in range(rounds):
        d = squared(x, centers)
        new = d.argmin(1)
        if label is not None and (new == label).all():
            break
        label = new
        n = np.bincount(label, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, label, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    d = squared(x, centers)
    return centers, d.argmin(1), float(d.min(1).sum())


def candidates(n: int) -> list[int]:
    """Numbers of clusters to try for ``n`` rows."""
    upper = int(min(10, max(4, round((max(n, 1) / 600.0) ** 0.5) + 4)))
    return [k for k in range(4, upper + 1) if k < n]


def bounded_sample(rows: DataFrame, n: int, most: int, seed: int, *columns: str) -> DataFrame:
    """The ``most`` rows of the least hashes of ``columns``; a threshold lets few more than those into the sort."""
    h = F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 40))
    share = (most + 6 * most**0.5 + 20) / max(n, 1)
    return rows.withColumn("_h", h).where(F.col("_h") < int(min(1.0, share) * (1 << 40))).orderBy("_h", *columns).limit(most).drop("_h")


def cluster_counts(rows: DataFrame, vector: str = "vector", most: int = 2000, starts: int = 12, seed: int = 7) -> DataFrame:
    """(clusters, found, within, calinski_harabasz, score) for each number of clusters tried, on a sample of at most ``most`` rows.

    Every number and start is a group of its own, as large as the sample; of a number's starts the one with least distance within
    counts.  The score takes 0.05 off the index for each cluster.  No row where the table is too small for four clusters.
    """
    ship(rows.sparkSession)
    n = rows.count()
    tried = candidates(n)
    sample = materialize(bounded_sample(rows.select(F.col(vector).alias("vector")), n, most, seed, "vector"), "sample")
    grid = rows.sparkSession.createDataFrame([(k, s) for k in tried for s in range(starts)], "clusters int, start int")

    def run(t: pa.Table) -> pa.Table:
        k, start = t.column("clusters")[0].as_py(), t.column("start")[0].as_py()
        x = np.array(t.column("vector").to_pylist(), np.float64)
        x = x[np.lexsort(x.T[::-1])]
        _, label, within = lloyd(x, k, seed + start)
        total = float(((x - x.mean(0)) ** 2).sum())
        return pa.table({"clusters": pa.array([k], pa.int32()), "start": pa.array([start], pa.int32()), "n": [len(x)], "found": [len(np.unique(label))], "within": [within], "total": [total]})

    # the grid has at most seven numbers times the starts
    each = sample.crossJoin(F.broadcast(grid)).groupBy("clusters", "start").applyInArrow(run, "clusters int, start int, n long, found long, within double, total double")
    best = each.groupBy("clusters").agg(F.min_by(F.struct("n", "found", "within", "total"), F.struct("within", "start")).alias("b")).select("clusters", "b.*")
    index = F.when(F.col("within") <= 0, 1.0).otherwise((F.col("total") - F.col("within")) * (F.col("n") - F.col("found")) / (F.col("within") * (F.col("found") - 1)))
    out = best.withColumn("calinski_harabasz", F.when((F.col("found") > 1) & (F.col("found") < F.col("n")), index))
    out = materialize(out.select("clusters", "found", "within", "calinski_harabasz", (F.col("calinski_harabasz") - 0.05 * F.col("clusters")).alias("score")), "cluster-counts")
    drop(sample)
    return out


def choose_cluster_count(rows: DataFrame, vector: str = "vector", most: int = 2000, starts: int = 12, seed: int = 7) -> int:
    """The number of clusters with the best score of :func:`cluster_counts`, of equal ones the least; for tiny tables two to four."""
    n = rows.count()
    if not candidates(n):
        return max(2, min(4, n))
    best = cluster_counts(rows, vector, most, starts, seed).where("score is not null").orderBy(F.desc("score"), "clusters").first()
    return int(best["clusters"]) if best else candidates(n)[0]


# --- moments ---------------------------------------------------------------------------------

_SQL = "`key` string, n long, sums binary, products binary"
_ARROW = pa.schema([("key", pa.string()), ("n", pa.int64()), ("sums", pa.binary()), ("products", pa.binary())])


def _added(t: pa.Table) -> pa.Table:
    sums, products = (sum(np.frombuffer(x, np.float64) for x in t.column(c).to_pylist()) for c in ("sums", "products"))
    return pa.Table.from_arrays([t.column("key").slice(0, 1), pa.array([sum(t.column("n").to_pylist())], pa.int64()), pa.array([sums.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())], schema=_ARROW)


def moments(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, n, sums, products) per value of ``key``, as text, and for all rows under a null key.

    Sums and products are doubles in bytes, elements squared of the latter.  Tasks sum up what they read; those matrices are added in two steps, so a
    key that all tasks have meets in no single one.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}
        for b in batches:
            keys = np.array([str(k) for k in b.column(0).to_pylist()], object)
            x = np.array(b.column(1).to_pylist(), np.float64)
            for k in [None, *dict.fromkeys(keys.tolist())] if len(x) else []:
                own = x if k is None else x[keys == k]
                part = [len(own), own.sum(0), own.T @ own]
                held[k] = [p + q for p, q in zip(held[k], part, strict=True)] if k in held else part
        for k, (n, s, p) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.string()), pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([p.tobytes()], pa.binary())], schema=_ARROW)

    part = rows.select(F.col(key).cast("string"), vector).mapInArrow(run, _SQL).withColumn("salt", F.spark_partition_id() % 64)

    def step(t: pa.Table) -> pa.Table:
        return _added(t.select(_ARROW.names))

    return part.groupBy("key", "salt").applyInArrow(step, _SQL).groupBy("key").applyInArrow(_added, _SQL)


def whole(row, less=None) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariance) of a row of :func:`moments`, or of what it holds beyond the row ``less``."""
    n, s, p = row["n"], np.frombuffer(row["sums"], np.float64), np.frombuffer(row["products"], np.float64)
    if less is not None:
        n, s, p = n - less["n"], s - np.frombuffer(less["sums"], np.float64), p - np.frombuffer(less["products"], np.float64)
    mean = s / max(n, 1)
    return n, mean, p.reshape(len(s), -1) / max(n, 1) - np.outer(mean, mean)


def projection(mean: np.ndarray, covariance: np.ndarray, dimensions: int, eps: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(scale, components) of standardised features: deviations up to ``eps`` count as one; a component's largest element is positive."""
    scale = np.sqrt(np.maximum(np.diag(covariance), 0.0))
    scale = np.where(scale <= eps, 1.0, scale)
    comp = np.linalg.eigh(covariance / np.outer(scale, scale))[1][:, ::-1][:, :dimensions].T
    return scale, comp * np.where(comp[np.arange(len(comp)), np.abs(comp).argmax(1)] < 0, -1.0, 1.0)[:, None]
