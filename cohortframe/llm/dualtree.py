"""Centroid clustering by dual-tree Lloyd rounds over cover trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortframe.llm.common import NULL_ID, drop, materialize, real_id, ship

#: Coordinates beyond this are set to it: squared distances then fit 64 bits.
LARGEST = 1 << 26
_EXACT = 1 << 22
#: Centres in turn with few vectors, after which the rest of a node counts as scattered.
MISSES = 32
_BLOCK = pa.schema([("ids", pa.binary()), ("points", pa.binary()), ("nodes", pa.binary()), ("radii", pa.binary())])
_BLOCK_SQL = "ids binary, points binary, nodes binary, radii binary"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between two sets of whole-number vectors."""
    top = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if top < _EXACT and a.shape[1] <= 64:
        x, y = a.astype(np.float64), b.astype(np.float64)
        # every product and sum is a whole number below 2**53
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1) if len(b) else np.empty((len(a), 0), np.int64)


class CoverTree:
    """A cover tree over vectors, laid out so that each node holds a range of them.

    ``nodes`` has a row (first vector, end, first child, end of children) per node and ``radii`` how far its vectors lie from its centre,
    the first of its range.  The centres below a node stand further apart than the level's radius, a power of two, and every vector lies within that of
    its centre; centres with few vectors share one leaf, and so do vectors left when :data:`MISSES` centres in turn had few.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray, radii: np.ndarray) -> None:
        self.points, self.order, self.nodes, self.radii = points, order, nodes, radii
        self._sums: np.ndarray | None = None

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> CoverTree:
        # centres are drawn in an order that does not depend on how rows are sorted
        order, nodes, radii = np.random.default_rng(0).permutation(len(points)), [[0, len(points), 0, 0]], [0.0]
        todo = [0] if len(points) else []
        while todo:
            k = todo.pop()
            a, z = nodes[k][:2]
            own = order[a:z].copy()
            far = np.sqrt(squared(points[own], points[own[:1]])[:, 0].astype(np.float64))
            radii[k] = float(far.max())
            if z - a <= leaf or radii[k] == 0:
                continue
            level = 2.0 ** (np.ceil(np.log2(radii[k])) - 1)
            groups, few, left, missed = [], [], np.arange(len(own)), 0
            while len(left) and missed < MISSES:
                # the node's centre is the first centre below it, then the first vector no centre covers
                near = far[left] if not groups and not few else np.sqrt(squared(points[own[left]], points[own[left[:1]]])[:, 0].astype(np.float64))
                inside = near <= level
                many = inside.sum() * 2 > leaf
                missed = 0 if many else missed + 1
                (groups if many else few).append(left[inside])
                left = left[~inside]
            if len(left):
                few.append(left)
            if len(groups) + bool(few) < 2:
                continue
            at, child = a, len(nodes)
            pool = [np.concatenate(few)] if few else []
            # the first vector of a range is the node's centre, so what holds it comes first
            for g in sorted(groups + pool, key=lambda g: g[0] != 0):
                order[at : at + len(g)] = own[g]
                pooled = bool(pool) and g is pool[0]
                radii.append(float(np.sqrt(squared(points[own[g]], points[own[g[:1]]]).astype(np.float64)).max()) if pooled else 0.0)
                if not pooled:
                    todo.append(len(nodes))
                nodes.append([at, at + len(g), 0, 0])
                at += len(g)
            nodes[k][2:] = child, len(nodes)
        return cls(points[order], order, np.array(nodes, np.int64), np.array(radii))

    def sums(self, a: int, z: int) -> np.ndarray:
        if self._sums is None:
            self._sums = np.vstack((np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, 0)))
        return self._sums[z] - self._sums[a]


class Rounds:
    """Assigns the vectors of cover trees to the nearest centroid, through a cover tree over the centroids."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids, self.tree = centroids, CoverTree.build(centroids, 1)
        #: Pairs of nodes skipped by their bounds, and vectors compared with a centroid.
        self.skipped = self.compared = 0

    def _near(self, centre: np.ndarray, radius: float, nodes: np.ndarray, leaf: bool) -> np.ndarray:
        """The centroid nodes that may hold the nearest centroid of some vector within ``radius`` of ``centre``."""
        t = self.tree
        while True:
            far = np.sqrt(squared(centre[None], t.points[t.nodes[nodes, 0]])[0].astype(np.float64))
            # some centroid is within this of every vector; a node whose every centroid is further cannot even tie
            within = (far.min() + radius) * (1 + 1e-12) + 1e-9
            keep = far - t.radii[nodes] - radius <= within
            self.skipped += int((~keep).sum())
            nodes = nodes[keep]
            wide = (t.nodes[nodes, 3] > 0) & (leaf | (t.radii[nodes] > radius))
            if not wide.any():
                return nodes
            nodes = np.concatenate((nodes[~wide], *(np.arange(*t.nodes[k, 2:]) for k in nodes[wide])))

    def assign(self, tree: CoverTree) -> Iterator[tuple[int, int, np.ndarray | int, np.ndarray | None]]:
        """(first, end, centroid, squared distances) of ranges of vectors: one centroid for all and None, or an array of each."""
        stack = [(0, np.zeros(1, np.int64))] if len(tree.points) else []
        own = self.tree
        while stack:
            v, nodes = stack.pop()
            a, z, child, end = tree.nodes[v].tolist()
            nodes = self._near(tree.points[a], float(tree.radii[v]), nodes, end == 0)
            first, last = own.nodes[nodes[0], :2].tolist()
            if len(nodes) == 1 and last - first == 1:
                yield a, z, int(own.order[first]), None
            elif end == 0:
                some = np.sort(np.concatenate([own.order[slice(*own.nodes[k, :2])] for k in nodes]))
                each = squared(tree.points[a:z], self.centroids[some])
                self.compared += each.size
                best = each.argmin(1)
                yield a, z, some[best], each[np.arange(z - a), best]
            else:
                stack.extend((c, nodes) for c in range(child, end))

    def totals(self, tree: CoverTree, sums: np.ndarray, sizes: np.ndarray) -> None:
        """Add the vectors of each centroid to ``sums`` and their number to ``sizes``."""
        for a, z, which, far in self.assign(tree):
            if far is None:
                sums[which] += tree.sums(a, z)
                sizes[which] += z - a
            else:
                order = np.argsort(which, kind="stable")
                at = np.flatnonzero(np.diff(which[order], prepend=-1))
                sums[which[order][at]] += np.add.reduceat(tree.points[a:z][order], at, axis=0)
                sizes += np.bincount(which, minlength=len(sizes))


def _trees(batches: Iterator[pa.RecordBatch], width: int, block_rows: int, leaf: int) -> Iterator[pa.RecordBatch]:
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    held = 0

    def block() -> pa.RecordBatch:
        tree = CoverTree.build(np.concatenate(rows), leaf)
        own = [np.concatenate(ids)[tree.order].astype("<i8"), tree.points.astype("<i4"), tree.nodes, tree.radii]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in own], schema=_BLOCK)

    for b in batches:
        x = b.column(1).flatten().to_numpy().reshape(-1, width)
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(256 * x), -LARGEST, LARGEST).astype(np.int64)
        keys = b.column(0).to_numpy()
        for at in range(0, len(keys), block_rows):
            ids.append(keys[at : at + block_rows])
            rows.append(whole[at : at + block_rows])
            held += len(ids[-1])
            if held >= block_rows:
                yield block()
                ids, rows, held = [], [], 0
    if held:
        yield block()


def _read(b: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, CoverTree]]:
    for k in range(b.num_rows):
        ids, points, nodes, radii = (b.column(c)[k].as_buffer() for c in range(4))
        p = np.frombuffer(points, "<i4").reshape(-1, width).astype(np.int64)
        yield np.frombuffer(ids, "<i8"), CoverTree(p, np.arange(len(p)), np.frombuffer(nodes, np.int64).reshape(-1, 4), np.frombuffer(radii, np.float64))


def _round(spark: SparkSession, trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids; as many sums as there are centroids times components come to the driver."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, sums, sizes = Rounds(centroids), np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for _, tree in _read(b, width):
                rounds.totals(tree, sums, sizes)
        flat = np.hstack((sums, sizes[:, None])).ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["at", "value"])

    got = trees.mapInArrow(run, "at long, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    total = [0] * (k * (width + 1))
    for r in got:
        total[r["at"]] = int(r["value"])
    out = centroids.copy()
    for c in range(k):
        row = total[c * (width + 1) : (c + 1) * (width + 1)]
        if row[-1]:
            out[c] = [s // row[-1] for s in row[:-1]]
    return out


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, seed: int = 2, block_rows: int = 8192, leaf: int = 32) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every usable row of ``vectors``.

    Vectors of exactly ``width`` components, none null or non-finite, become whole numbers, floor(256 * x); beyond 2**26 either way, where no
    squared distance would fit a long, that bound is taken.  The first centroids are the ``k`` vectors with the least hash of ``seed`` and vec_id (equal
    ones by their components); with fewer vectors there are fewer centroids.  Every round assigns each vector to its nearest centroid, the one with the smaller number of equally
    near ones, and moves centroids to the floors of the means; those without vectors stay.  All of it is exact.

    Each task builds cover trees over the vectors it reads, ``block_rows`` at a time, once; they are a written table that every round reads.  A
    round builds a cover tree over the centroids, descends both trees, skips pairs of nodes that are provably too far, gives whole nodes
    to a centroid where only one is left, and compares leaves exactly.  Rows are never shuffled.

    A null vec_id is hashed as no digits and stays null; repeated rows are vectors each; other columns are ignored; an empty table
    gives an empty one.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("embedding").cast("array<double>")
    good = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("id"), v.alias("vector"), F.coalesce(good, F.lit(False)).alias("good")).where("good").select("id", "vector")
    trees = materialize(rows.mapInArrow(lambda batches: _trees(batches, width, block_rows, leaf), _BLOCK_SQL), "cover-trees")

    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(real_id("id").cast("string"), F.lit(""))), 256)
    # the result's order of rows: k rows come to the driver
    start = rows.orderBy(name, "vector").limit(k).collect()
    centroids = np.clip(np.floor(256 * np.array([r["vector"] for r in start], np.float64).reshape(-1, width)), -LARGEST, LARGEST).astype(np.int64)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _round(spark, trees, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = Rounds(centroids)
        for b in batches:
            for ids, tree in _read(b, width):
                which, far = np.empty(len(ids), np.int32), np.empty(len(ids), np.int64)
                for a, z, own, apart in last.assign(tree):
                    which[a:z] = own
                    far[a:z] = squared(tree.points[a:z], centroids[own : own + 1])[:, 0] if apart is None else apart
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(which), pa.array(far)], ["id", "cluster", "distance"])

    found = materialize(trees.mapInArrow(run, "id long, cluster int, distance long"), "clusters")
    drop(trees)
    hashes = [(c, hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)]
    names = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    whole = sums.agg(F.sum("own").cast("long").alias("inertia"))
    per = sums.join(names, "cluster").select("cluster", F.col("own").cast("long").alias("cluster_inertia"), "centroid_sha256").crossJoin(whole)
    # at most k rows
    return found.join(F.broadcast(per), "cluster").select(real_id("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
