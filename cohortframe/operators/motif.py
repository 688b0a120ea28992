"""A frozen, sample-balanced motif model: normalise by sample, project, cluster, assign, align.

``rows``: obs_id, sample_id, vector array<double>.  Fitting sees a bounded training set (the same number of rows per sample);
assigning is a map over all rows with the model in the closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.operators.clustering import bounded_sample, choose_cluster_count, lloyd, moments, projection, squared, whole
from cohortframe.operators.vectors import nearest_centroid
from cohortframe.plans.ship import ship
from cohortframe.plans.tables import drop, materialize


@dataclass
class MotifModel:
    """Centre and scale of the features, projection rows, centroids in the projected space, and the clusters' mean feature vectors."""

    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray
    centroids: np.ndarray
    feature_centroids: np.ndarray


def normalize_by_sample(rows: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Vectors centred and scaled within their sample (population deviation; up to ``eps`` counts as one).

    Means come from one aggregation per sample and element; the row keeps its array, so no row is split and put together again.
    """
    each = rows.select("sample_id", F.posexplode("vector").alias("i", "v")).groupBy("sample_id", "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stat = each.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") <= eps, 1.0).otherwise(F.col("s")).alias("s")))).alias("_t"))
    out = rows.join(stat, "sample_id").withColumn("vector", F.zip_with("vector", "_t", lambda x, t: (x - t["m"]) / t["s"]))
    return out.drop("_t")


def balanced_training(rows: DataFrame, most: int = 2048, seed: int = 7) -> DataFrame:
    """As many rows of each sample as the smallest one has, ``most`` at the most, in order of a hash of obs_id.

    A threshold on the hash, six deviations above what is needed, lets few more rows than those into the window.
    """
    sizes = rows.groupBy("sample_id").agg(F.count("*").alias("_n"))
    take = min(sizes.agg(F.min("_n")).first()[0] or 0, most)
    share = (take + 6 * take**0.5 + 20) / F.col("_n")
    hashed = rows.join(F.broadcast(sizes), "sample_id").withColumn("_h", F.xxhash64("obs_id", F.lit(seed)))
    few = hashed.where(F.pmod("_h", F.lit(1 << 40)) < share * float(1 << 40))
    r = F.row_number().over(W.partitionBy("sample_id").orderBy(F.pmod("_h", F.lit(1 << 40)), "obs_id"))
    return few.withColumn("_r", r).where(F.col("_r") <= take).drop("_r", "_n", "_h")


def fit(rows: DataFrame, clusters: int | None = None, dimensions: int = 12, most: int = 2048, seed: int = 7, balanced: bool = True) -> MotifModel:
    """Fit on the balanced rows of samples already normalised, or, for a pooled model, on all rows as they are.

    Means, deviations and covariances come from moments that executors sum up, as many numbers as features squared; eigenvectors have their
    largest element positive, so that a run repeats.  Without ``clusters`` their number is chosen on a bounded sample.
    """
    train = materialize((balanced_training(rows, most, seed) if balanced else rows).select("obs_id", "vector"), "training")
    try:
        _, mean, covariance = whole(moments(train.withColumn("key", F.lit("all")), "key").where("key is null").first())
        scale, comp = projection(mean, covariance, dimensions)
        low = train.select("obs_id", "vector", _project(_standard("vector", mean, scale), comp).alias("low"))
        clusters = clusters or choose_cluster_count(low, "low", seed=seed)
        centers = KMeans(k=clusters, seed=seed, initMode="k-means||", maxIter=50).fit(low.select(array_to_vector("low").alias("features"))).clusterCenters()
        model = MotifModel(mean, scale, comp, np.array(sorted(map(tuple, centers))), np.zeros((len(centers), len(mean))))
        means = assign(train, model).select("motif_id", F.posexplode("vector").alias("i", "v")).groupBy("motif_id", "i").agg(F.avg("v").alias("m"))
        for r in means.collect():
            model.feature_centroids[int(r["motif_id"][6:]), r["i"]] = r["m"]
    finally:
        drop(train)
    return model


def _standard(column: str, mean: np.ndarray, scale: np.ndarray):
    t = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, scale, strict=True)])
    return F.zip_with(column, t, lambda x, y: (x - y["m"]) / y["s"])


def _project(column: str, components: np.ndarray):
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in components])
    return F.transform(rows, lambda c: F.aggregate(F.zip_with(column, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def assign(rows: DataFrame, model: MotifModel) -> DataFrame:
    """Every row's motif (``motif_00``, ...) and its squared distance to the centroid."""
    z = rows.withColumn("_z", _standard("vector", model.mean, model.scale)).withColumn("_p", _project("_z", model.components))
    c = rows.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(model.centroids)], "centroid_id int, centroid array<double>")
    out = nearest_centroid(z, c, "_p").drop("_z", "_p")
    return out.withColumn("motif_id", F.format_string("motif_%02d", "centroid_id")).drop("centroid_id")


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column for each row of a square cost matrix that makes the sum least (shortest augmenting paths)."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, came, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[at]:
            used[at] = True
            free = ~used
            free[0] = False
            now = cost[match[at] - 1] - u[match[at]] - v[1:]
            better = free[1:] & (now < least[1:])
            least[1:][better], came[1:][better] = now[better], at
            to = int(np.where(free, least, np.inf).argmin())
            step = least[to]
            u[match[used]] += step
            v[used] -= step
            least[free] -= step
            at = to
        while at:
            match[at] = match[came[at]]
            at = came[at]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


def align(model: MotifModel, reference: MotifModel) -> tuple[dict[str, str], float]:
    """The reference motif of each motif, one to one, by the clusters' mean feature vectors, and the mean cost."""
    a, b = model.feature_centroids, reference.feature_centroids
    if len(a) != len(b):
        raise ValueError("models have different numbers of motifs")
    cost = ((a[:, None] - b[None]) ** 2).sum(2)
    to = assignment(cost)
    return {f"motif_{i:02d}": f"motif_{j:02d}" for i, j in enumerate(to)}, float(cost[np.arange(len(a)), to].mean())


@dataclass
class Folds:
    """Models of many folds side by side: a fold is named by the sample it leaves out.  Axis 0 is the fold everywhere."""

    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray
    centers: np.ndarray

    def project(self, f: int, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean[f]) / self.scale[f]) @ self.components[f].T

    def nearest(self, f: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which center of fold ``f``, given in features, is nearest to each row once projected, and the squared distance."""
        d = squared(self.project(f, x), self.project(f, self.centers[f]))
        return d.argmin(1), d.min(1)


def _started(total, sample: list[tuple[str, list[float]]], clusters: int, dimensions: int, starts: int, seed: int):
    """Per fold: its projection, from all moments less its own, and starting centers from a sample without its own rows."""
    keys, x = np.array([k for k, _ in sample], object), np.array([v for _, v in sample], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                _, mean, covariance = whole(total, r)
                scale, comp = projection(mean, covariance, dimensions)
                own = x[keys != r["key"]]
                low = ((own - mean) / scale) @ comp.T
                _, label, _ = min((lloyd(low, clusters, seed + i) for i in range(starts)), key=lambda t: t[2])
                centers = np.array([own[label == c].mean(0) if (label == c).any() else own[c % len(own)] for c in range(clusters)])
                yield pa.RecordBatch.from_pylist([{"key": r["key"], **{c: v.astype(np.float64).tobytes() for c, v in (("mean", mean), ("scale", scale), ("components", comp), ("centers", centers))}}])

    return run


def _moved(train: DataFrame, folds: Folds) -> float:
    """One round for every fold at once; how far any center moved."""
    f_n, k, d = folds.centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((f_n, k, d)), np.zeros((f_n, k))
        for b in batches:
            keys, x = np.array(b.column(0).to_pylist(), object), np.array(b.column(1).to_pylist(), np.float64)
            for f in range(f_n if len(x) else 0):
                own = x[keys != folds.names[f]]
                label, _ = folds.nearest(f, own)
                one = np.zeros((len(own), k))
                one[np.arange(len(own)), label] = 1.0
                sums[f] += one.T @ own
                sizes[f] += one.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(f_n)), pa.array([s.tobytes() for s in sums], pa.binary()), pa.array([s.tobytes() for s in sizes], pa.binary())], ["f", "sums", "sizes"])

    def add(t: pa.Table) -> pa.Table:
        a, z = (sum(np.frombuffer(v, np.float64) for v in t.column(c).to_pylist()) for c in ("sums", "sizes"))
        return pa.table({"f": t.column("f").slice(0, 1), "sums": pa.array([a.tobytes()], pa.binary()), "sizes": pa.array([z.tobytes()], pa.binary())})

    far = 0.0
    for r in train.mapInArrow(run, "f long, sums binary, sizes binary").groupBy("f").applyInArrow(add, "f long, sums binary, sizes binary").collect():
        n = np.frombuffer(r["sizes"], np.float64)[:, None]
        new = np.where(n > 0, np.frombuffer(r["sums"], np.float64).reshape(k, d) / np.maximum(n, 1), folds.centers[r["f"]])
        far = max(far, float(np.abs(new - folds.centers[r["f"]]).max()))
        folds.centers[r["f"]] = new
    return far


def fold_models(rows: DataFrame, clusters: int, dimensions: int = 12, most: int = 2048, seed: int = 7, starts: int = 6, rounds: int = 30, sample_rows: int = 2000, block: int = 1000) -> list[Folds]:
    """A model for each sample, fitted on the balanced rows of all others.

    Counts, sums and products are summed once per sample; a fold's are all of them less its own.  Its centers start from a sample of
    at most ``sample_rows`` rows, without its own, and move over all training rows; a round is one job for all folds.  So the
    number of jobs does not grow with samples, but for blocks of ``block`` folds, whose models travel to every task.
    """
    ship(rows.sparkSession)
    train = materialize(balanced_training(rows, most, seed).select(F.col("sample_id").cast("string").alias("sample_id"), "vector"), "training")
    sums = materialize(moments(train, "sample_id"), "moments")
    total = sums.where("key is null").first()
    out: list[Folds] = []
    if total is None:
        return out
    some = [(r["sample_id"], r["vector"]) for r in bounded_sample(train, total["n"], sample_rows, seed, "sample_id", "vector").collect()]
    made = sums.where("key is not null").mapInArrow(_started(total.asDict(), some, clusters, dimensions, starts, seed), "`key` string, mean binary, scale binary, components binary, centers binary")
    made = materialize(made, "folds")
    n = made.count()
    for b in range(-(-n // block)):
        part = made.where(F.pmod(F.xxhash64("key"), F.lit(-(-n // block))) == b).orderBy("key").collect()
        if not part:
            continue
        d = len(np.frombuffer(part[0]["mean"], np.float64))
        folds = Folds([r["key"] for r in part], *(np.array([np.frombuffer(r[c], np.float64).reshape(shape) for r in part]) for c, shape in (("mean", (d,)), ("scale", (d,)), ("components", (-1, d)), ("centers", (-1, d)))))
        for _ in range(rounds):
            if _moved(train, folds) <= 1e-9:
                break
        out.append(folds)
    for t in (train, sums, made):
        drop(t)
    return out


def held_out_motifs(rows: DataFrame, reference: MotifModel, dimensions: int = 12, most: int = 2048, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Every row's motif by a model that has not seen its sample, in the names of ``reference``, and one row per fold.

    Models are those of :func:`fold_models`, aligned one to one by their centers.  A fold tells the agreement with the
    reference's own assignment, the mean cost of the alignment and the mean squared distance.  A null sample is no fold.
    """
    spark = rows.sparkSession
    blocks = fold_models(rows.where("sample_id is not null"), len(reference.centroids), dimensions, most, seed)
    whole_rows = assign(rows, reference).select("obs_id", F.col("sample_id").cast("string").alias("sample_id"), "vector", F.col("motif_id").alias("full_motif_id"))
    count, costs, parts = sum(len(b.names) for b in blocks), [], []
    for folds in blocks:
        names = []
        for f, held in enumerate(folds.names):
            cost = squared(folds.centers[f], reference.feature_centroids)
            to = assignment(cost)
            names.append([f"motif_{j:02d}" for j in to])
            costs.append((held, count - 1, float(cost[np.arange(len(to)), to].mean())))
        parts.append(whole_rows.where(F.col("sample_id").isin(folds.names) if len(blocks) > 1 else F.col("sample_id").isNotNull()).mapInArrow(_assigned(folds, names), "obs_id string, sample_id string, motif_id string, full_motif_id string, distance2 double"))
    schema = "sample_id string, n_train_samples int, alignment_cost_mean double"
    out = parts[0] if parts else spark.createDataFrame([], "obs_id string, sample_id string, motif_id string, full_motif_id string, distance2 double")
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialize(out.withColumn("obs_id", F.col("obs_id").cast(rows.schema["obs_id"].dataType)), "held-out")
    one = out.groupBy("sample_id").agg(F.count("*").alias("n_test"), F.avg((F.col("motif_id") == F.col("full_motif_id")).cast("double")).alias("agreement"), F.avg("distance2").alias("distance_mean"))
    one = one.join(spark.createDataFrame(costs, schema), "sample_id")
    return out, one.select(F.col("sample_id").alias("held_out_sample"), "n_train_samples", "n_test", "agreement", "alignment_cost_mean", "distance_mean")


def _assigned(folds: Folds, names: list[list[str]]):
    place = {s: f for f, s in enumerate(folds.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, x = np.array(b.column(1).to_pylist(), object), np.array(b.column(2).to_pylist(), np.float64)
            motif, far = np.empty(len(keys), object), np.zeros(len(keys))
            for s in dict.fromkeys(keys.tolist()):
                own = np.flatnonzero(keys == s)
                label, far[own] = folds.nearest(place[s], x[own])
                motif[own] = np.array(names[place[s]], object)[label]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(motif, pa.string()), b.column(3), pa.array(far)], ["obs_id", "sample_id", "motif_id", "full_motif_id", "distance2"])

    return run
