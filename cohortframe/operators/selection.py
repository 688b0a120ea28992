"""Feature scores from a graph or from states, and selections that avoid what resembles each other.

``expression``: obs, gene, value (zeros are not stored but count); ``edges``: src, dst, weight between observations; ``states``: obs, state, a
row for every observation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.operators.hvg import z_all
from cohortframe.plans.ship import ship
from cohortframe.plans.tables import drop, materialize


#: Cells of the matrices of nodes by genes that a task of :func:`graph_locality` holds.
_CELLS = 1 << 20
_SUMS = ("sy", "syy", "say", "sxy", "sax")


def _wanted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(block, dst, own, at, w): whose values a block of nodes needs, at which places in it with which weights; ``own`` is its place if it lies there."""
    placed = nodes.select(F.col("obs").alias("src"), "block", F.col("at").alias("to"))
    e = edges.join(placed, "src").select("block", "dst", F.lit(None).cast("int").alias("own"), F.struct("to", "weight").alias("x"))
    own = nodes.select("block", F.col("obs").alias("dst"), F.col("at").alias("own"), F.lit(None).cast(e.schema["x"].dataType).alias("x"))
    t = e.unionByName(own).groupBy("block", "dst").agg(F.max("own").alias("own"), F.collect_list("x").alias("x"))
    return t.select("block", "dst", "own", F.col("x.to").alias("at"), F.col("x.weight").alias("w"))


def _block_sums(genes: int):
    """Sums by gene over a block's nodes, with x a node's value, y its neighbours' weighted sum and a the sum of the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict = {}
        x, y, a = np.zeros((0, genes)), np.zeros((0, genes)), np.zeros(0)
        for b in batches:
            own, to, weight = b.column(0).fill_null(-1).to_numpy(), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            rows = 1 + int(max(own.max(initial=-1), to.max(initial=-1)))
            if rows > len(a):
                more = max(rows, 2 * len(a)) - len(a)
                x, y, a = np.vstack((x, np.zeros((more, genes)))), np.vstack((y, np.zeros((more, genes)))), np.concatenate((a, np.zeros(more)))
            np.add.at(a, to, weight)
            coded = b.column(3).flatten().dictionary_encode(null_encoding="encode")
            column = np.array([index.setdefault(g, len(index)) for g in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            kind, value = coded.type.value_type, b.column(4).flatten().to_numpy()
            edge, cut = (np.concatenate(([0], np.cumsum(b.column(c).value_lengths().fill_null(0).to_numpy()))).tolist() for c in (1, 3))
            cells = y.reshape(-1)
            for i in range(b.num_rows):
                g, v = column[cut[i] : cut[i + 1]], value[cut[i] : cut[i + 1]]
                if own[i] >= 0:
                    np.add.at(x[own[i]], g, v)
                # an edge may be listed twice
                at, w = to[edge[i] : edge[i + 1]], weight[edge[i] : edge[i + 1]]
                np.add.at(cells, (at[:, None].astype(np.int64) * genes + g).ravel(), (w[:, None] * v).ravel())
        if index:
            sums = [m.sum(0)[: len(index)] for m in (y, y * y, a[:, None] * y, x * y, a[:, None] * x)]
            yield pa.RecordBatch.from_arrays([pa.array(list(index), kind), *map(pa.array, sums)], ["gene", *_SUMS])

    return run


def graph_locality(expression: DataFrame, edges: DataFrame, n_obs: int, penalty: float = 0.18, cells: int = _CELLS) -> DataFrame:
    """(gene, locality, residual, score): how much a gene's standardised expression agrees with its neighbours' weighted sum.

    With z the standardised expression and Az what the graph makes of it, locality is the mean of z * Az, residual the mean of (z - Az)**2, and the score
    locality less ``penalty`` times residual.  Deviations below 1e-6 count as that.  Both means follow from sums over stored values
    and over the products of edges with them.

    Nodes are dealt into blocks by ranges of their name, so many to a block that a matrix with all genes has about ``cells`` cells.  An
    observation's values travel as one row to each block that has an edge to it, not once an edge and gene; near names in the graph mean few blocks.
    """
    ship(expression.sparkSession)
    pair = F.struct("gene", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("x"))
    rows = materialize(expression.groupBy("obs").agg(F.collect_list(pair).alias("p")).select("obs", F.col("p.gene").alias("genes"), F.col("p.x").alias("values")), "expression")
    stored = rows.select(F.explode(F.arrays_zip("genes", "values")).alias("p")).select(F.col("p.genes").alias("gene"), F.col("p.values").alias("x"))
    own = materialize(stored.groupBy("gene").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx")), "own")
    genes = max(1, own.count())
    edges = materialize(edges.select("src", "dst", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")), "edges")
    reach = materialize(edges.groupBy(F.col("src").alias("obs")).agg(F.sum("weight").alias("a")), "reach")
    sums = F.broadcast(reach.agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("sa"), F.coalesce(F.sum(F.col("a") * F.col("a")), F.lit(0.0)).alias("saa")))
    blocks = -(-reach.count() * genes // cells) or 1
    place = F.monotonically_increasing_id()  # the part in the upper bits, the row in it in the lower 33
    nodes = reach.select("obs").repartitionByRange(blocks, "obs").select("obs", F.shiftright(place, 33).cast("int").alias("block"), place.bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("at"))
    nodes = materialize(nodes, "nodes")
    wanted = _wanted(edges, nodes).hint("merge")
    sent = wanted.join(rows.withColumnRenamed("obs", "dst"), "dst", "left").repartitionById(blocks, F.col("block")).select("own", "at", "w", "genes", "values")
    kinds = ", ".join([f"gene {dict(expression.dtypes)['gene']}", *(f"{c} double" for c in _SUMS)])
    smooth = materialize(sent.mapInArrow(_block_sums(genes), kinds), "smooth").groupBy("gene").agg(*[F.sum(c).alias(c) for c in _SUMS])
    for done in (rows, edges, nodes):
        drop(done)
    t = own.join(smooth, "gene", "left").fillna(0.0).crossJoin(sums)
    m = F.col("sx") / n_obs
    t = t.withColumn("m", m).withColumn("v", F.greatest(F.col("sxx") - n_obs * m * m, F.lit(0.0)))
    t = t.withColumn("s2", F.pow(F.greatest(F.sqrt(F.col("v") / n_obs), F.lit(1e-6)), F.lit(2.0)))
    cross = F.col("sxy") - F.col("m") * F.col("sax") - F.col("m") * F.col("sy") + F.col("m") * F.col("m") * F.col("sa")
    square = F.col("syy") - 2.0 * F.col("m") * F.col("say") + F.col("m") * F.col("m") * F.col("saa")
    # a constant gene agrees with nothing; what rounding leaves of its deviation is not scaled up
    flat = F.col("v") <= 1e-12 * F.col("sxx")
    t = t.withColumn("locality", F.when(flat, 0.0).otherwise(cross / F.col("s2") / n_obs)).withColumn("residual", F.when(flat, 0.0).otherwise((F.col("v") - 2.0 * cross + square) / F.col("s2") / n_obs))
    return t.select("gene", "locality", "residual", (F.col("locality") - penalty * F.col("residual")).alias("score"))


def _order_value(place: str):
    """The value at a place (from 0) of all observations' values in order, zeros first."""
    return F.coalesce(F.max(F.when(F.col("r") == F.col(place) - F.col("zeros"), F.col("x"))), F.lit(0.0))


def state_information(expression: DataFrame, states: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(gene, information, entropy, gain, score): what a gene, cut at its quantiles 0.33 and 0.67, tells of the observations' states.

    Values above neither, one or both quantiles (linear between order values, zeros included) make three bins.  Information and
    entropy are in bits; gain is the information over the states' entropy.  The score takes z of the gain, less 0.32 z of the
    entropy, less 0.45 z of the absolute correlation with log library size, plus 0.15 z of the variance, and z of that.  Zeros are in the lowest
    bin and are counted from what is not stored.  ``totals`` (obs, total) are the library sizes, by default the sums of the values.
    """
    n = states.count()
    x = materialize(expression.select("obs", "gene", F.col("value").cast("double").alias("x")), "expression")
    k = x.groupBy("gene").agg(F.count("*").alias("k"))
    at = {q: (n - 1) * q for q in (0.33, 0.67)}
    places = k.select("gene", (F.lit(n) - F.col("k")).alias("zeros"), *[F.lit(int(np.floor(at[q])) + d).alias(f"p{i}{d}") for i, q in enumerate(at) for d in (0, 1)])
    ranked = x.withColumn("r", F.row_number().over(W.partitionBy("gene").orderBy("x", "obs")) - 1).join(places, "gene")
    cuts = ranked.groupBy("gene", "zeros").agg(*[_order_value(f"p{i}{d}").alias(f"v{i}{d}") for i in (0, 1) for d in (0, 1)])
    cuts = cuts.select("gene", *[(F.col(f"v{i}0") + (F.col(f"v{i}1") - F.col(f"v{i}0")) * F.lit(float(p - np.floor(p)))).alias(f"q{i}") for i, p in enumerate(at.values())])
    binned = x.join(cuts, "gene").select("obs", "gene", ((F.col("x") > F.col("q0")).cast("int") + (F.col("x") > F.col("q1")).cast("int")).alias("bin"))
    stored = binned.join(states, "obs").groupBy("gene", "state", "bin").agg(F.count("*").alias("c"))
    sizes = materialize(states.groupBy("state").agg(F.count("*").alias("ns")), "states")
    # zeros of a gene in a state: what is not stored there
    none = k.select("gene").crossJoin(F.broadcast(sizes)).join(stored.groupBy("gene", "state").agg(F.sum("c").alias("seen")), ["gene", "state"], "left")
    none = none.select("gene", "state", F.lit(0).alias("bin"), (F.col("ns") - F.coalesce("seen", F.lit(0))).alias("c")).where("c > 0")
    joint = stored.unionByName(none).groupBy("gene", "state", "bin").agg(F.sum("c").alias("c")).join(F.broadcast(sizes), "state")
    each = joint.groupBy("gene", "bin").agg(F.sum("c").alias("cb"), F.collect_list(F.struct("c", "ns")).alias("cells"))
    p, pb = F.lit(1.0 / n), F.col("cb") / F.lit(float(n))
    info = F.aggregate("cells", F.lit(0.0), lambda s, z: s + z["c"] * p * F.log2(z["c"] * p / (z["ns"] * p * pb + 1e-12)))
    told = each.groupBy("gene").agg(F.sum(info).alias("information"), F.sum(-pb * F.log2(pb + 1e-12)).alias("entropy"))
    ps = F.col("ns") / F.lit(float(n))
    whole = F.broadcast(sizes.agg(F.greatest(F.sum(-ps * F.log2(ps + 1e-12)), F.lit(1e-8)).alias("h")))
    told = told.crossJoin(whole).withColumn("gain", F.col("information") / F.col("h"))
    both = told.join(depth_correlation(x, states, n, totals), "gene")
    raw = z_all(F.col("gain")) - 0.32 * z_all(F.col("entropy")) - 0.45 * z_all(F.col("depth_correlation")) + 0.15 * z_all(F.col("variance"))
    return both.withColumn("raw", raw).select("gene", "information", "entropy", "gain", z_all(F.col("raw")).alias("score"))


def depth_correlation(x: DataFrame, states: DataFrame, n: int, totals: DataFrame | None = None) -> DataFrame:
    """(gene, variance, depth_correlation): population variance, and the absolute correlation with log1p of the observation's total.

    ``x``: obs, gene, x; ``totals`` (obs, total) are the library sizes, by default the sums of x.  A constant gene correlates with nothing.
    """
    totals = x.groupBy("obs").agg(F.sum("x").alias("total")) if totals is None else totals
    depth = states.select("obs").join(totals, "obs", "left").select("obs", F.log1p(F.coalesce("total", F.lit(0.0))).alias("d"))
    of_all = F.broadcast(depth.agg(F.avg("d").alias("md"), F.stddev_pop("d").alias("sd")))
    t = x.join(depth, "obs").groupBy("gene").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("d")).alias("sxd")).crossJoin(of_all)
    m = F.col("sx") / n
    variance = F.greatest(F.col("sxx") / n - m * m, F.lit(0.0))
    corr = F.abs((F.col("sxd") / n - m * F.col("md")) / (F.sqrt(variance) * F.col("sd")))
    return t.select("gene", variance.alias("variance"), F.when((variance > 1e-18) & (F.col("sd") > 1e-9), corr).otherwise(0.0).alias("depth_correlation"))


# --- diverse selections --------------------------------------------------------------------------


def greedy(base: np.ndarray, alike: np.ndarray, k: int, penalty: float) -> list[int]:
    """Rows chosen one by one: the largest base value less ``penalty`` times the likeness to the most similar row chosen so far; the first of equal ones."""
    if len(base) <= k:
        return list(range(len(base)))
    most, free, out = np.zeros(len(base)), np.ones(len(base), bool), []
    for _ in range(k):
        worth = np.where(free, base - penalty * most, -np.inf)
        i = int(worth.argmax())
        out.append(i)
        free[i] = False
        most = np.maximum(most, alike[i])
    return out


def gene_correlation(expression: DataFrame, genes: list, n_obs: int) -> np.ndarray:
    """The absolute correlations of a bounded list of genes over all observations, zeros included.

    Rows are gathered by observation, no longer than the list; tasks add up products as one dense matrix, whose rows are then added.
    """
    ship(expression.sparkSession)
    p = len(genes)
    names = F.broadcast(expression.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], f"gene {dict(expression.dtypes)['gene']}, i int"))
    rows = expression.join(names, "gene").groupBy("obs").agg(F.collect_list("i").alias("i"), F.collect_list(F.col("value").cast("double")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, sums = np.zeros((p, p)), np.zeros(p)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                cut = b.slice(at, 512)
                dense = np.zeros((cut.num_rows, p))
                lengths = cut.column(0).value_lengths().to_numpy()
                dense[np.repeat(np.arange(cut.num_rows), lengths), cut.column(0).flatten().to_numpy()] = cut.column(1).flatten().to_numpy()
                gram += dense.T @ dense
                sums += dense.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p + 1)), pa.array([r.tobytes() for r in np.vstack((gram, sums))], pa.binary())], ["i", "row"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"i": t.column("i").slice(0, 1), "row": pa.array([sum(np.frombuffer(x, np.float64) for x in t.column("row").to_pylist()).tobytes()], pa.binary())})

    whole = np.zeros((p + 1, p))
    for r in rows.select("i", "x").mapInArrow(run, "i long, `row` binary").groupBy("i").applyInArrow(add, "i long, `row` binary").collect():
        whole[r["i"]] = np.frombuffer(r["row"], np.float64)
    gram, mean = whole[:-1], whole[-1] / max(n_obs, 1)
    scale = np.maximum(np.sqrt(np.maximum(np.diag(gram) / max(n_obs, 1) - mean**2, 0)), 1e-6)
    flat = n_obs * scale**2 <= 1e-12 * np.diag(gram)
    corr = (gram - n_obs * np.outer(mean, mean)) / np.outer(scale, scale) / max(n_obs - 1, 1)
    corr[flat], corr[:, flat] = 0.0, 0.0
    return np.minimum(np.abs(corr), 1.0)


def diverse_selection(scores: DataFrame, expression: DataFrame, n_obs: int, k: int, score: str = "score", penalty: float = 0.3, most: int = 1200) -> DataFrame:
    """(gene, base, position, final_score): ``k`` genes chosen by score and unlikeness among the best of them, the others below.

    ``base`` is the percentile rank, ties by gene.  The pool has four times ``k`` genes, at least ``k`` + 64 and at most ``most``; within it
    each choice takes the largest percentile less ``penalty`` times the largest correlation with what is chosen (of equal ones the
    lower score's).  Chosen genes score from 2 down to above 1, the others their percentile less 2.  Fewer than eight genes, or ``k`` below 2, are
    left in order of score, position null.
    """
    spark = scores.sparkSession
    n = scores.count()
    order = W.orderBy(F.col(score), "gene")  # a row per gene
    ranked = materialize(scores.select("gene", F.col(score).alias("base_score"), ((F.row_number().over(order) - 0.5) / n).alias("base")), "ranked")
    k = max(1, min(k, n))
    if k < 2 or n < 8:
        return ranked.select("gene", "base", F.lit(None).cast("int").alias("position"), F.col("base_score").alias("final_score"))
    size = min(n, max(k * 4, k + 64), most)
    pool = [r["gene"] for r in ranked.orderBy(F.desc("base")).limit(size).collect()][::-1]
    alike = gene_correlation(expression, pool, n_obs)
    np.fill_diagonal(alike, 0.0)
    chosen = greedy((np.arange(len(pool)) + 0.5) / len(pool), alike, k, penalty)
    worth = np.linspace(2.0, 1.0, len(chosen), endpoint=False)
    picked = spark.createDataFrame([(pool[i], j + 1, float(worth[j])) for j, i in enumerate(chosen)], f"gene {dict(scores.dtypes)['gene']}, position int, worth double")
    out = ranked.join(F.broadcast(picked), "gene", "left")
    return out.select("gene", "base", "position", F.coalesce("worth", F.col("base") - 2.0).alias("final_score"))


