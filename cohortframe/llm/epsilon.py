"""Embedding near-dedup by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import NULL_ID, materialize
from cohortframe.llm.components import connected_components
from cohortframe.plans.ship import ship

#: Leading principal dimensions that the grid has.
AXES = 6
#: Axes whose cells blocks meet in, and the side of a tile of pairs, in blocks.
KEYS = 3
TILE = 8
_LEAF = 256
_BLOCK = pa.schema([("group", pa.string()), ("block", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("sizes", pa.binary()), ("unit", pa.binary())])
_BLOCK_SQL = "`group` string, block long, lo array<double>, hi array<double>, ids binary, sizes binary, unit binary"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rows(b: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.array(v.as_py()) for v in b.column(name)]


def principal_axes(classes: DataFrame, lengths: int = 8, longest: int = 4096) -> dict[int, np.ndarray]:
    """The leading principal axes of the unit vectors, for the ``lengths`` most frequent vector lengths up to ``longest``.

    Executors add up products; as many numbers as these covariance matrices have come to the driver, a fixed bound.
    Vectors of other lengths are projected on their first components, which are axes like any other.
    """
    usual = classes.groupBy(F.size("vector").alias("d")).count().where(F.col("d") <= longest).orderBy(F.desc("count"), "d").limit(lengths)
    wanted = frozenset(r["d"] for r in usual.collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            rows = _rows(b, "vector")
            for d in {len(r) for r in rows} & wanted:
                u = unit(np.array([r for r in rows if len(r) == d]))
                u = np.hstack((u, np.ones((len(u), 1))))
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, s in sums.items():
            flat = s.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d)), pa.array(np.arange(len(flat))), pa.array(flat)], ["d", "i", "v"])

    ship(classes.sparkSession)
    got = classes.select("vector").mapInArrow(run, "d long, i long, v double").groupBy("d", "i").agg(F.sum("v").alias("v")).toPandas()
    axes = {}
    for d, part in got.groupby("d"):
        s = np.zeros((d + 1) ** 2)
        s[part["i"].to_numpy()] = part["v"].to_numpy()
        s = s.reshape(d + 1, d + 1)
        mean = s[:-1, -1] / s[-1, -1]
        _, vectors = np.linalg.eigh(s[:-1, :-1] / s[-1, -1] - np.outer(mean, mean))
        axes[int(d)] = vectors[:, ::-1][:, :AXES]
    return axes


def project(u: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """The places of unit vectors on the axes of their length."""
    own = axes.get(u.shape[1])
    return u @ own if own is not None else u[:, :AXES]


def _label(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id each row and column reaches through the links of one leaf."""
    rows, cols = rows.copy(), cols.copy()
    none = np.iinfo(np.int64).max
    while True:
        new_rows = np.minimum(rows, np.where(linked, cols, none).min(1))
        new_cols = np.minimum(cols, np.where(linked, new_rows[:, None], none).min(0))
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


class Sequence:
    """An interval of the grid order: unit vectors, their projections, ids and how many vectors each stands for."""

    def __init__(self, r: dict, axes: dict[int, np.ndarray]) -> None:
        self.ids, self.sizes = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int64)
        self.unit = np.frombuffer(r["unit"], np.float64).reshape(len(self.ids), -1)
        self.at = project(self.unit, axes)
        self.links, self.root = np.zeros(len(self.ids), np.int64), self.ids.copy()
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, z) not in self.boxes:
            self.boxes[a, z] = (self.at[a:z].min(0), self.at[a:z].max(0))
        return self.boxes[a, z]


def apart(lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, reach: float) -> bool:
    """Are two boxes further apart than ``reach``?"""
    gap = np.maximum(0, np.maximum(lo2 - hi1, lo1 - hi2))
    return float(gap @ gap) > reach * reach


def join_sequences(s: Sequence, t: Sequence, least: float, edges: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Recursively join two intervals (or one with itself): halves that are provably distant are skipped."""
    reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    stack = [(0, len(s.ids), 0, len(t.ids))]
    while stack:
        a, b, c, d = stack.pop()
        if s is t and c < a:
            continue
        if apart(*s.box(a, b), *t.box(c, d), reach):
            continue
        if b - a > _LEAF or d - c > _LEAF:
            for x, y in [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > _LEAF else [(a, b)]:
                for u, v in [(c, (c + d) // 2), ((c + d) // 2, d)] if d - c > _LEAF else [(c, d)]:
                    stack.append((x, y, u, v))
            continue
        linked = s.unit[a:b] @ t.unit[c:d].T >= least
        if s is t and a == c:
            np.fill_diagonal(linked, False)
        if not linked.any():
            continue
        s.links[a:b] += linked @ t.sizes[c:d]
        if s is not t or a != c:
            t.links[c:d] += s.sizes[a:b] @ linked
        rows, cols = _label(linked, s.ids[a:b], t.ids[c:d])
        for ids, root in ((s.ids[a:b], rows), (t.ids[c:d], cols)):
            moved = ids != root
            edges.append((ids[moved], root[moved]))


def near_blocks(boxes: DataFrame, reach: float) -> DataFrame:
    """(block1, block2), block1 <= block2, once each: blocks of a group whose boxes (group, block, lo, hi) are within ``reach``.

    Boxes meet in cells on the leading axes: those that one spans and the other, widened by a cell, reaches; the first common
    cell makes the pair.  Cells have a side of ``reach`` or a quarter at least, so a box within [-1, 1] spans a bounded number.
    """
    side = max(reach, 0.25)
    ends = [(f"from{k}", f"upto{k}") for k in range(KEYS)]
    for k, (a, z) in enumerate(ends):
        # vectors shorter than that have one cell on the axes they lack
        boxes = boxes.withColumn(a, F.floor(F.coalesce(F.try_element_at("lo", F.lit(k + 1)), F.lit(0.0)) / side)).withColumn(z, F.floor(F.coalesce(F.try_element_at("hi", F.lit(k + 1)), F.lit(0.0)) / side))
    left, right = (boxes.select("group", *[F.col(c).alias(f"{c}_{n}") for c in boxes.columns if c != "group"]) for n in "12")
    meets = F.lit(True)
    for k, (a, z) in enumerate(ends):
        left = left.withColumn(f"x{k}", F.explode(F.sequence(F.col(f"{a}_1") - 1, F.col(f"{z}_1") + 1)))
        right = right.withColumn(f"x{k}", F.explode(F.sequence(f"{a}_2", f"{z}_2")))
        meets = meets & (F.col(f"x{k}") == F.greatest(F.col(f"{a}_1") - 1, F.col(f"{a}_2")))
    gap = F.aggregate(F.arrays_zip("lo_1", "hi_1", "lo_2", "hi_2"), F.lit(0.0), lambda s, z: s + F.pow(F.greatest(F.lit(0.0), z["lo_2"] - z["hi_1"], z["lo_1"] - z["hi_2"]), F.lit(2.0)))
    out = left.join(right, ["group", *[f"x{k}" for k in range(KEYS)]]).where((F.col("block_1") <= F.col("block_2")) & meets & (gap <= reach * reach + 1e-9))
    return out.select(F.col("block_1").alias("block1"), F.col("block_2").alias("block2"))


def tiles(pairs: DataFrame, width: int) -> DataFrame:
    """(c1, c2, block, pairs): every block once for each tile of ``width`` by ``width`` blocks that a pair of it lies in, with the tile's pairs.

    Blocks are numbered in grid order, so those of a tile are neighbours; a block is sent to as many tiles as its pairs lie in,
    not once for each pair.
    """
    c1, c2 = (F.floor(F.col(c) / width).cast("long").alias(n) for c, n in (("block1", "c1"), ("block2", "c2")))
    own = pairs.groupBy(c1, c2).agg(F.collect_list(F.struct("block1", "block2")).alias("pairs"))
    return own.select("c1", "c2", F.explode(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["block1"], p["block2"]))))).alias("block"), "pairs")


def embedding_links(vectors: DataFrame, least: float = 0.93, block_rows: int = 4096, block_bytes: int = 2 << 20) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is ``least`` or more.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different length.  ``n_links`` counts the other vectors linked directly; ``component_id`` is the smallest vec_id
    that links reach; ``kept`` marks its vector.

    Equal vectors of a label are one class, so a vector that a third of the rows share is one row with a weight.
    Classes are put in grid order, by label and by cells of side sqrt(2 - 2 * least) on the leading principal axes
    of all vectors, and cut into blocks of ``block_rows`` rows or ``block_bytes`` bytes.  Blocks meet in cells on three axes; pairs whose
    boxes may be in reach are dealt into tiles of eight by eight blocks, and a task joins the pairs of a tile by recursion, so that
    it holds sixteen blocks.  A class is known by two 64-bit hashes of its vector.
    A tile gives at most one count and a few spanning edges per vector and pair of blocks, not pairs of vectors.
    A null vec_id comes after all others; other columns are ignored; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("embedding").cast("array<double>")
    good = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("label").cast("string").alias("label"), v.alias("vector"), F.coalesce(good, F.lit(False)).alias("good"))
    usable = rows.where("good").select("id", F.concat_ws("|", F.size("vector").cast("string"), "label").alias("group"), "vector")
    # -0.0 and 0.0 are one number; two hashes name a class, so that vectors need not be shuffled again
    usable = usable.withColumn("vector", F.transform("vector", lambda x: x + 0.0)).withColumn("h1", F.xxhash64("group", "vector")).withColumn("h2", F.xxhash64(F.lit(1), "group", "vector"))
    classes = materialize(usable.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min_by("group", "id").alias("group"), F.min_by("vector", "id").alias("vector")), "classes")
    axes = principal_axes(classes)
    cell = float(np.sqrt(max(1e-12, 2 - 2 * least)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = _rows(b, "vector")
            cells, units = [], []
            for x in vectors:
                u = unit(x[None])[0]
                at = project(u[None], axes)[0]
                cells.append(np.floor(at / cell).astype(np.int64).tolist() + [float(at[0])])
                units.append(u.tobytes())
            key = pa.array([[float(c) for c in row] for row in cells], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), key, pa.array(units, pa.binary())], ["group", "id", "n", "cells", "unit"])

    placed = classes.select("group", "id", "n", "vector").mapInArrow(place, "`group` string, id long, n long, cells array<double>, unit binary")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialize(placed, "placed").repartitionByRange(tasks, "group", "cells", "id").sortWithinPartitions("group", "cells", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        group, ids, sizes, units = None, [], [], []

        def block() -> pa.RecordBatch:
            u = np.frombuffer(b"".join(units), np.float64).reshape(len(ids), -1)
            at = project(u, axes)
            return pa.RecordBatch.from_pylist([{"group": group, "block": (part << 32) + made, "lo": at.min(0).tolist(), "hi": at.max(0).tolist(), "ids": np.array(ids, np.int64).tobytes(), "sizes": np.array(sizes, np.int64).tobytes(), "unit": b"".join(units)}], schema=_BLOCK)

        for b in batches:
            for g, i, n, u in zip(*(b.column(c).to_pylist() for c in ("group", "id", "n", "unit")), strict=True):
                if ids and (g != group or len(ids) >= block_rows or (len(ids) + 1) * len(u) > block_bytes):
                    yield block()
                    made, ids, sizes, units = made + 1, [], [], []
                group = g
                ids.append(i)
                sizes.append(n)
                units.append(u)
        if ids:
            yield block()

    blocks = materialize(ordered.select("group", "id", "n", "unit").mapInArrow(cut, _BLOCK_SQL), "blocks")
    pairs = materialize(near_blocks(blocks.select("group", "block", "lo", "hi"), cell), "pairs")
    dealt = tiles(pairs, TILE).join(blocks.select("block", "ids", "sizes", "unit").hint("merge"), "block")

    def match(tile: pa.Table) -> pa.Table:
        wanted = tile.column("pairs")[0].as_py()
        found = {r["block"]: Sequence(r, axes) for r in tile.select(["block", "ids", "sizes", "unit"]).to_pylist()}
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for p in wanted:
            join_sequences(found[p["block1"]], found[p["block2"]], least, edges)
        ids, links = (np.concatenate([getattr(q, c)[q.links > 0] for q in found.values()]) for c in ("ids", "links"))
        both = np.unique(np.stack([np.concatenate(x) for x in zip(*edges, strict=True)], 1), axis=0) if edges else np.zeros((0, 2), np.int64)
        none = pa.nulls(len(both), pa.int64()), pa.nulls(len(ids), pa.int64())
        return pa.table({"id": pa.array(np.concatenate((ids, both[:, 0]))), "links": pa.chunked_array([pa.array(links), none[0]]), "to": pa.chunked_array([none[1], pa.array(both[:, 1].copy())])})

    found = materialize(dealt.groupBy("c1", "c2").applyInArrow(match, "id long, links long, to long"), "links")
    counts = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("`to` is not null"), "id", "to").withColumnRenamed("node", "id")
    named = classes.select("h1", "h2", "id", "n").join(counts, "id", "left").join(roots, "id", "left")
    named = named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "id").alias("root"))
    out = usable.select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", "links", "root").unionByName(rows.where(~F.col("good")).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("root")))

    def real(c: str):
        return F.when(F.col(c) != NULL_ID, F.col(c))

    return out.select(real("id").alias("vec_id"), F.col("links").alias("n_links"), real("root").alias("component_id"), (F.col("id") == F.col("root")).alias("kept"))
