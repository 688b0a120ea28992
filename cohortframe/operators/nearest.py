"""Exact nearest neighbours in vector space, and what rests on them.

``rows``: obs_id, vector array<double>.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.operators.clustering import bounded_sample
from cohortframe.operators.vectors import squared_distance
from cohortframe.plans.ship import ship
from cohortframe.plans.tables import drop, materialize

_BLOCK = pa.schema([("block", pa.int64()), ("cell", pa.int64()), ("ids", pa.list_(pa.int64())), ("unit", pa.binary()), ("center", pa.list_(pa.float64())), ("radius", pa.float64()), ("reach", pa.float64())])
_BLOCK_SQL = "block long, cell long, ids array<long>, unit binary, center array<double>, radius double, reach double"
_FOUND_SQL = "src long, dst long, dist double"


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by differences: equal vectors are at exactly zero, and equally distant copies tie."""
    return np.sqrt(((a - b) ** 2).sum(-1))


def nearest_of(x: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, id, distance) of the ``k`` nearest of y to each row of x, but for its own id; equally near ones by id.

    Products of matrices choose what is compared by differences: all within rounding of the k-th.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    y2 = (y * y).sum(1)
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        rough = (part * part).sum(1)[:, None] + y2 - 2 * part @ y.T
        rough[own[at : at + 256, None] == ids] = np.inf
        m = min(k, len(y))
        top = np.partition(rough, m - 1, axis=1)[:, m - 1]
        slack = 1e-9 * ((part * part).sum(1) + y2.max()) + 1e-12
        row, col = np.nonzero((rough <= (top + slack)[:, None]) & np.isfinite(rough))
        far = exact(part[row], y[col])
        order = np.lexsort((ids[col], far, row))
        row, col, far = row[order], col[order], far[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        out.append((row[keep] + at, ids[col[keep]], far[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def gap(a: str, b: str) -> Column:
    return F.sqrt(squared_distance(F.col(a), F.col(b)))


def _packed(x: np.ndarray) -> bytes:
    """The rows as bytes; as single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return b"f" + small.tobytes() if (small == x).all() else b"d" + x.tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if data[:1] == b"f" else np.float64, offset=1).reshape(n, -1).astype(np.float64)


class _Best:
    """The ``k`` nearest so far of the rows of a block; only what is within ``kth`` of a row counts."""

    def __init__(self, x: np.ndarray, kth: np.ndarray, k: int) -> None:
        self.x, self.kth, self.k = x, kth.copy(), k
        self.x2 = (x * x).sum(1)
        self.left = np.concatenate((-2 * x, np.ones((len(x), 1))), 1)
        self.row, self.id, self.far = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def meet(self, y: np.ndarray, ids: np.ndarray) -> None:
        """Products of matrices choose what is compared by differences: all within rounding of a row's limit."""
        y2 = (y * y).sum(1)
        limit = self.kth * self.kth - self.x2 + 1e-9 * (self.x2 + y2.max()) + 1e-12
        row, col = np.nonzero(self.left @ np.concatenate((y, y2[:, None]), 1).T <= limit[:, None])
        if not len(row):
            return
        far = np.concatenate([exact(self.x[row[i : i + 65536]], y[col[i : i + 65536]]) for i in range(0, len(row), 65536)])
        near = far <= self.kth[row]
        row, at, far = (np.concatenate(c) for c in ((self.row, row[near]), (self.id, ids[col[near]]), (self.far, far[near])))
        order = np.lexsort((at, far, row))
        row, at, far = row[order], at[order], far[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        last = place == self.k - 1
        self.kth[row[last]] = np.minimum(self.kth[row[last]], far[last])
        self.row, self.id, self.far = row[keep], at[keep], far[keep]


def _cut(pivots: np.ndarray, block_rows: int):
    """Rows dealt by cell, in order of their distance from its pivot, cut into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        cell, ids, rows = None, [], []

        def block() -> pa.RecordBatch:
            x = np.array(rows, np.float64)
            center = x.mean(0)
            return pa.RecordBatch.from_pylist([{"block": made, "cell": cell, "ids": ids, "unit": _packed(x), "center": center.tolist(), "radius": float(exact(x, center).max()), "reach": None}], schema=_BLOCK)

        for b in batches:
            for c, i, v in zip(*(b.column(n).to_pylist() for n in ("cell", "id", "vector")), strict=True):
                if ids and (c != cell or len(ids) >= block_rows):
                    yield block()
                    made, ids, rows = made + 1, [], []
                cell = c
                ids.append(i)
                rows.append(v)
        if ids:
            yield block()

    return run


def _near_pivot(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(1).to_pylist(), np.float64)
                d = np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d.argmin(1)), pa.array(np.sqrt(d.min(1)))], ["id", "vector", "cell", "far"])

    return run


def vector_neighbors(rows: DataFrame, k: int = 15, block_rows: int = 1024, most_pivots: int = 256, seed: int = 7, tile_rows: int | None = None) -> DataFrame:
    """(src, dst, dist, rank): the ``k`` nearest other rows of each row by Euclidean distance; equally near ones by obs_id (long).

    Rows are dealt to cells of the nearest pivot (a bounded sample) and cut into blocks of ``block_rows`` with a center and
    a radius.  Each block first searches itself; the largest k-th distance found is its reach.  A second block is searched only if
    its center is not further than the two radii and that reach, which loses no neighbour.  Blocks travel once per pair of tiles of ``tile_rows`` rows
    (a twelfth of all, 65,536 at most), and candidates of a row are k per tile at most.  Rows whose vector is null are left out.
    """
    ship(rows.sparkSession)
    spark = rows.sparkSession
    own = rows.where("vector is not null").select(F.col("obs_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    n = own.count()
    if not n:
        return spark.createDataFrame([], "src long, dst long, dist double, rank int")
    count = int(min(most_pivots, max(1, (n / block_rows) ** 0.5 * 4)))
    pivots = np.unique(np.array([r["vector"] for r in bounded_sample(own, n, count, seed, "id").collect()], np.float64), axis=0)
    placed = own.mapInArrow(_near_pivot(pivots), "id long, vector array<double>, cell long, far double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(placed, "cells").repartitionByRange(parts, "cell", "far", "id").sortWithinPartitions("cell", "far", "id")
    plain = materialize(dealt.select("cell", "id", "vector").mapInArrow(_cut(pivots, block_rows), _BLOCK_SQL), "blocks")

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.array(r["ids"], np.int64)
                x = _unpacked(r["unit"], len(ids))
                src, dst, far = nearest_of(x, ids, x, ids, k)
                # fewer than k others in the block: any distance may be needed
                kth = np.full(len(ids), np.inf)
                if len(ids) > k:
                    kth = np.zeros(len(ids))
                    np.maximum.at(kth, src, far)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([float(kth.max())]), pa.array([kth.tolist()], pa.list_(pa.float64())), pa.array([ids[src].tolist()], pa.list_(pa.int64())), pa.array([dst.tolist()], pa.list_(pa.int64())), pa.array([far.tolist()], pa.list_(pa.float64()))], ["block", "reach", "kth", "src", "dst", "dist"])

    first = materialize(plain.mapInArrow(inner, "block long, reach double, kth array<double>, src array<long>, dst array<long>, dist array<double>"), "within")
    # cells are met before blocks, so that far cells cost one row each
    blocks = plain.select("block", "cell", "center", "radius").join(first.select("block", "reach"), "block")
    cells = blocks.groupBy("cell").agg(F.max("reach").alias("reach"))
    at = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell long, pivot array<double>")
    wide = plain.join(F.broadcast(at), "cell").select("cell", (gap("center", "pivot") + F.col("radius")).alias("wide")).groupBy("cell").agg(F.max("wide").alias("wide"))
    cells = materialize(cells.join(wide, "cell").join(at, "cell"), "cell-bounds")
    # at most as many cells as pivots
    left, right = cells.toDF("cell1", "reach1", "wide1", "pivot1"), cells.select("cell", "wide", "pivot").toDF("cell2", "wide2", "pivot2")
    met = left.crossJoin(F.broadcast(right)).where(gap("pivot1", "pivot2") <= F.col("wide1") + F.col("wide2") + F.col("reach1") + 1e-9).select("cell1", "cell2")
    one = blocks.select(F.col("block").alias("block1"), F.col("cell").alias("cell1"), F.col("center").alias("c1"), F.col("radius").alias("r1"), "reach")
    two = blocks.select(F.col("block").alias("block2"), F.col("cell").alias("cell2"), F.col("center").alias("c2"), F.col("radius").alias("r2"))
    pairs = one.join(F.broadcast(met), "cell1").join(two, "cell2").where("block1 != block2").where(gap("c1", "c2") <= F.col("r1") + F.col("r2") + F.col("reach") + 1e-9).select("block1", "block2")
    pairs = materialize(pairs, "block-pairs")
    size = min(1 << 16, max(4 * block_rows, -(-n // 12))) if tile_rows is None else tile_rows
    # one row a block
    tiles = materialize(plain.select("block", (F.sum(F.size("ids")).over(W.orderBy("block")) / size).cast("long").alias("tile")), "tiles")
    met = pairs.join(F.broadcast(tiles.toDF("block1", "t1")), "block1").join(F.broadcast(tiles.toDF("block2", "t2")), "block2")
    units = plain.select("block", "ids", "unit", "center", "radius").join(first.select("block", "reach", "kth"), "block")
    asks = units.join(met.select(F.col("block1").alias("block"), "t1", "t2").distinct(), "block").withColumn("asks", F.lit(True))
    asked = units.withColumn("kth", F.lit(None).cast("array<double>")).join(met.select(F.col("block2").alias("block"), "t1", "t2").distinct(), "block").withColumn("asks", F.lit(False))

    def outer(t: pa.Table) -> pa.Table:
        ids, kth = ([r.values.to_numpy() if r.is_valid else None for r in t.column(c)] for c in ("ids", "kth"))
        center, block = np.array(t.column("center").to_pylist(), np.float64), t.column("block").to_numpy()
        radius, reach, asks = (t.column(c).to_numpy() for c in ("radius", "reach", "asks"))
        others = np.flatnonzero(~asks)
        whole = {j: _unpacked(t.column("unit")[j].as_py(), len(ids[j])) for j in others.tolist()}
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for i in np.flatnonzero(asks).tolist():
            best = _Best(_unpacked(t.column("unit")[i].as_py(), len(ids[i])), kth[i], k)
            apart = exact(center[others], center[i])
            for j in others[np.argsort(apart, kind="stable")].tolist():
                if block[j] != block[i] and exact(center[j], center[i]) <= radius[i] + radius[j] + min(reach[i], best.kth.max()) + 1e-9:
                    best.meet(whole[j], ids[j])
            out.append((ids[i][best.row], best.id, best.far))
        return pa.table(dict(zip(("src", "dst", "dist"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    columns = ["t1", "t2", "asks", "block", "ids", "unit", "center", "radius", "reach", "kth"]
    found = asks.select(columns).unionByName(asked.select(columns)).groupBy("t1", "t2").applyInArrow(outer, _FOUND_SQL)
    near = first.select(F.explode(F.arrays_zip("src", "dst", "dist")).alias("e")).select("e.src", "e.dst", "e.dist")
    best = near.unionByName(found).withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy("dist", "dst")))
    out = materialize(best.where(F.col("rank") <= k).select("src", "dst", "dist", F.col("rank").cast("int").alias("rank")), "neighbors")
    for t in (plain, first, cells, tiles):
        drop(t)
    return out


def neighbor_preservation(reference: DataFrame, test: DataFrame, k: int = 15) -> DataFrame:
    """One row: the mean Jaccard similarity of a row's nearest neighbours in two spaces; 0 for two rows or fewer."""
    both = reference.where("vector is not null").select("obs_id").join(test.where("vector is not null").select("obs_id"), "obs_id", "left_semi")
    if both.count() <= 2:
        return reference.sparkSession.createDataFrame([(0.0,)], "preservation double")
    a, b = (vector_neighbors(t.join(both, "obs_id", "left_semi"), k).select("src", "dst") for t in (reference, test))
    sizes = a.groupBy("src").agg(F.count("*").alias("n"))
    shared = a.join(b, ["src", "dst"]).groupBy("src").agg(F.count("*").alias("m"))
    each = sizes.join(shared, "src", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return each.agg(F.avg(F.col("m") / (2 * F.col("n") - F.col("m"))).alias("preservation"))


def label_conservation(rows: DataFrame, label: str, k: int = 15) -> DataFrame:
    """One row: the mean share of a row's ``k`` nearest others (by vector) that have its label, over all rows; null labels are one label."""
    near = vector_neighbors(rows, k)
    names = rows.select(F.col("obs_id").cast("long").alias("id"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("l"))
    same = near.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
    return same.groupBy("src").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("s")).agg(F.avg("s").alias("conservation"))
