"""Queries of models, neighbours in vector space, gene scores and the selector; registered with those of :mod:`cohortframe.catalogue`."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortframe.catalogue import _LOGS, _counts, _query, _r, _table, _vectors
from cohortframe.operators import vectors as V
from cohortframe.plans.tables import materialize

# --- clusterings ---------------------------------------------------------------------------


@_query("""WITH x AS (SELECT label AS c, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE label IS NOT NULL), p AS (SELECT c, i, count(*) AS m, avg(v) AS a, var_pop(v) AS s FROM x GROUP BY ALL),
g AS (SELECT i, avg(v) AS g, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT max(n) AS n, count(DISTINCT c) AS clusters, sum(m * (a - g) ** 2) AS between, sum(m * s) AS within FROM p JOIN g USING (i))
SELECT n, clusters, round(between, 6) AS between, round(within, 6) AS within, round(between * (n - clusters) / (within * (clusters - 1)), 6) AS calinski_harabasz FROM t""")
def calinski_harabasz(spark, sf_dir):
    from cohortframe.operators import clustering as C

    t = C.calinski_harabasz(_vectors(spark, sf_dir).where("vector is not null"), "motif_id")
    return t.select("n", "clusters", *[F.round(c, 6).alias(c) for c in ("between", "within", "calinski_harabasz")])


@_query()
def cluster_counts(spark, sf_dir):
    """Numbers of clusters of all vectors, projected on eight axes of their pooled features."""
    from cohortframe.operators import clustering as C
    from cohortframe.operators import motif as M

    rows = _vectors(spark, sf_dir).where("vector is not null")
    _, mean, cov = C.whole(C.moments(rows, "motif_id").where("key is null").first())
    scale, comp = C.projection(mean, cov, 8)
    return C.cluster_counts(rows.select(M._project(M._standard("vector", mean, scale), comp).alias("vector")))


@_query("""WITH x AS (SELECT vec_id % 8 AS key, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT CAST(key AS VARCHAR) AS key, i, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM x GROUP BY ALL UNION ALL SELECT 'all', i, count(*), avg(v), var_pop(v) FROM x GROUP BY ALL)
SELECT key, n, round(sum(m), 8) AS mean_sum, round(sum(s), 8) AS variance_sum FROM p GROUP BY ALL""")
def sample_moments(spark, sf_dir):
    """The moments behind out-of-fold models: per sample and of all rows."""
    from cohortframe.operators import clustering as C

    t = C.moments(_vectors(spark, sf_dir).where("vector is not null"), "sample_id")

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                n, mean, cov = C.whole(r)
                yield pa.RecordBatch.from_pydict({"key": [r["key"] or "all"], "n": [n], "mean_sum": [float(mean.sum())], "variance_sum": [float(np.trace(cov))]})

    return _r(t.mapInArrow(rows, "`key` string, n long, mean_sum double, variance_sum double"))


@_query()
def pooled_motifs(spark, sf_dir):
    """A model of all rows as they are, with its own number of motifs, assigned to all of them."""
    from cohortframe.operators import motif as M

    rows = _vectors(spark, sf_dir).where("vector is not null").select("obs_id", "sample_id", "vector")
    return M.assign(rows, M.fit(rows, None, 8, balanced=False)).select("obs_id", "sample_id", "motif_id", F.round("distance2", 6).alias("distance2"))


# --- neighbours in vector space ----------------------------------------------------------------

_NEAR = """n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.label AS la, b.label AS lb, sqrt(list_sum(list_transform(range(1, {0} + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS dist FROM n a JOIN n b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM d QUALIFY rank <= 15)"""


@_query(f"WITH {_NEAR.format('len(a.v)')} SELECT src, dst, round(dist, 8) AS dist, rank::INTEGER AS rank FROM k")
def vector_neighbors(spark, sf_dir):
    from cohortframe.operators import nearest as K

    return _r(K.vector_neighbors(_vectors(spark, sf_dir)))


@_query(f"WITH {_NEAR.format('len(a.v)')} SELECT round(avg(s), 8) AS conservation FROM (SELECT src, avg((coalesce(la, -1) = coalesce(lb, -1))::INT) AS s FROM k GROUP BY ALL)")
def label_conservation(spark, sf_dir):
    from cohortframe.operators import nearest as K

    return _r(K.label_conservation(_vectors(spark, sf_dir), "motif_id"))


@_query(f"""WITH {_NEAR.format('len(a.v)')}, h AS (SELECT * FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt(list_sum(list_transform(range(1, 33), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS dist FROM n a JOIN n b ON a.vec_id <> b.vec_id)) WHERE rank <= 15),
s AS (SELECT k.src, count(*) AS m FROM k JOIN h USING (src, dst) GROUP BY ALL), c AS (SELECT src, count(*) AS n FROM k GROUP BY ALL) SELECT round(avg(coalesce(m, 0) / (2 * n - coalesce(m, 0))::DOUBLE), 8) AS preservation FROM c LEFT JOIN s USING (src)""")
def neighbor_preservation(spark, sf_dir):
    """How many neighbours the first half of the elements keeps."""
    from cohortframe.operators import nearest as K

    rows = _vectors(spark, sf_dir)
    return _r(K.neighbor_preservation(rows, rows.withColumn("vector", F.slice("vector", 1, 32))))


# --- gene scores ---------------------------------------------------------------------------------

_RING = "e AS (SELECT a.s_suppkey AS src, b.s_suppkey AS dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY a.s_suppkey) AS weight FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey AND abs(a.s_suppkey - b.s_suppkey) <= 200)"


def _ring(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), "s_nationkey", F.floor(F.col("s_suppkey") / 201).alias("cell"))
    # keys no more than 200 apart lie in the same cell of 201 or in adjoining ones
    near = s.select(F.col("src").alias("dst"), "s_nationkey", F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])).alias("cell"))
    e = s.join(near, ["s_nationkey", "cell"]).where("src != dst and abs(src - dst) <= 200")
    return e.join(e.groupBy("src").agg(F.count("*").alias("n")), "src").select("src", "dst", (1.0 / F.col("n")).alias("weight"))


def _logs(spark, sf_dir):
    return V.log_cp10k(_counts(spark, sf_dir)).select("obs", "gene", F.col("expression").alias("value"))


@_query(f"""{_LOGS.split(', e AS')[0]}, ex AS (SELECT obs, gene, ln(1 + value * 10000 / greatest(sum(value) OVER (PARTITION BY obs), 1)) AS x FROM counts), {_RING}, o AS (SELECT DISTINCT obs FROM counts), gn AS (SELECT DISTINCT gene FROM counts),
dn AS (SELECT obs, gene, coalesce(x, 0) AS x FROM o CROSS JOIN gn LEFT JOIN ex USING (obs, gene)), z AS (SELECT obs, gene, (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-6) AS z FROM dn WINDOW w AS (PARTITION BY gene)),
s AS (SELECT z.obs, z.gene, any_value(z.z) AS z, coalesce(sum(e.weight * y.z), 0) AS s FROM z LEFT JOIN e ON e.src = z.obs LEFT JOIN z y ON y.obs = e.dst AND y.gene = z.gene GROUP BY z.obs, z.gene)
SELECT gene, round(avg(z * s), 7) AS locality, round(avg((z - s) ** 2), 7) AS residual, round(avg(z * s) - 0.18 * avg((z - s) ** 2), 7) AS score FROM s GROUP BY gene""")
def graph_locality(spark, sf_dir):
    """Suppliers are observations, those of a nation neighbours; parts modulo 200 are genes."""
    from cohortframe.operators import selection as S

    x = _logs(spark, sf_dir)
    obs = materialize(_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("obs")).distinct(), "obs")
    e = _ring(spark, sf_dir).join(obs.withColumnRenamed("obs", "src"), "src", "left_semi").join(obs.withColumnRenamed("obs", "dst"), "dst", "left_semi")
    t = S.graph_locality(x, e, obs.count())
    return t.select("gene", *[F.round(c, 7).alias(c) for c in ("locality", "residual", "score")])


def _z(c: str) -> str:
    return f"CASE WHEN stddev_pop({c}) OVER () < 1e-8 THEN 0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END"


@_query(f"""{_LOGS.split(', e AS')[0]}, ex AS (SELECT obs, gene, ln(1 + value * 10000 / greatest(sum(value) OVER (PARTITION BY obs), 1)) AS x FROM counts), o AS (SELECT obs, obs % 4 AS state FROM counts GROUP BY ALL), gn AS (SELECT DISTINCT gene FROM counts),
dn AS (SELECT obs, state, gene, coalesce(x, 0) AS x FROM o CROSS JOIN gn LEFT JOIN ex USING (obs, gene)), q AS (SELECT gene, quantile_cont(x, 0.33) AS q0, quantile_cont(x, 0.67) AS q1 FROM dn GROUP BY ALL), nn AS (SELECT count(*)::DOUBLE AS nn FROM o),
b AS (SELECT gene, state, (x > q0)::INT + (x > q1)::INT AS bin FROM dn JOIN q USING (gene)), j AS (SELECT gene, state, bin, count(*) / any_value(nn) AS p FROM b, nn GROUP BY gene, state, bin), ps AS (SELECT state, count(*) / any_value(nn) AS ps FROM o, nn GROUP BY state),
pg AS (SELECT gene, bin, sum(p) AS pg FROM j GROUP BY ALL), h AS (SELECT -sum(ps * log2(ps + 1e-12)) AS h FROM ps), i AS (SELECT gene, sum(p * log2(p / (ps * pg + 1e-12))) AS information FROM j JOIN ps USING (state) JOIN pg USING (gene, bin) GROUP BY gene),
en AS (SELECT gene, -sum(pg * log2(pg + 1e-12)) AS entropy FROM pg GROUP BY gene), lib AS (SELECT obs, ln(1 + sum(value)) AS d FROM counts GROUP BY obs), dc AS (SELECT gene, var_pop(x) AS variance, CASE WHEN var_pop(x) > 1e-18 THEN abs(corr(x, d)) ELSE 0 END AS dp FROM dn JOIN lib USING (obs) GROUP BY gene),
t AS (SELECT gene, information, entropy, information / greatest(h, 1e-8) AS gain, variance, dp FROM i JOIN en USING (gene) JOIN dc USING (gene), h), r AS (SELECT *, {_z('gain')} - 0.32 * {_z('entropy')} - 0.45 * {_z('dp')} + 0.15 * {_z('variance')} AS raw FROM t)
SELECT gene, round(information, 8) AS information, round(entropy, 8) AS entropy, round(gain, 8) AS gain, round({_z('raw')}, 6) AS score FROM r""")
def state_information(spark, sf_dir):
    """What genes (parts modulo 200) tell of suppliers' states (keys modulo 4)."""
    from cohortframe.operators import selection as S

    c, x = _counts(spark, sf_dir), _logs(spark, sf_dir)
    t = S.state_information(x, x.select("obs").distinct().withColumn("state", F.col("obs") % 4), c.groupBy("obs").agg(F.sum("value").alias("total")))
    return t.select("gene", *[F.round(c, 8).alias(c) for c in ("information", "entropy", "gain")], F.round("score", 6).alias("score"))


@_query()
def diverse_genes(spark, sf_dir):
    """Forty genes chosen by variability and unlikeness."""
    from cohortframe.operators import hvg as H
    from cohortframe.operators import selection as S

    c, x = _counts(spark, sf_dir), _logs(spark, sf_dir)
    n = c.select("obs").distinct().count()
    return _r(S.diverse_selection(H.base_scores(c, n).select("gene", F.col("variance_score").alias("score")), x, n, 40))


# --- singular vectors and scores made from them -------------------------------------------------

_EX = f"{_LOGS.split(', e AS')[0]}, ex AS (SELECT obs, gene, ln(1 + value * 10000 / greatest(sum(value) OVER (PARTITION BY obs), 1)) AS x FROM counts)"
_DENSE = f"{_EX}, o AS (SELECT DISTINCT obs FROM counts), gn AS (SELECT DISTINCT gene FROM counts), dn AS (SELECT obs, gene, coalesce(x, 0) AS x FROM o CROSS JOIN gn LEFT JOIN ex USING (obs, gene))"
_MOMENTS = "mo AS (SELECT gene, avg(x) AS mean, var_pop(x) AS variance, avg((x > 0)::INT) AS prevalence, sum(x) / (count(*) FILTER (x > 0) + 1e-8) AS separation FROM dn GROUP BY gene)"


def _bump(c: str, center: float, width: float) -> str:
    return f"exp(-(((({c}) - {center}) / {width}) ** 2))"


def _rounded(df, places: int = 6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@_query(f"{_EX} SELECT gene, round(sum(x * x), 5) AS energy FROM ex GROUP BY gene")
def svd_energy(spark, sf_dir):
    """What all singular values and vectors tell of each gene: its sum of squares."""
    from cohortframe.operators import decomposition as D

    x = _logs(spark, sf_dir)
    obs = x.select("obs").distinct()
    rows = D.sparse_rows(x, obs.count(), obs)
    svd = D.truncated_svd(rows, len(rows.genes))
    energy = (svd.loadings**2 @ svd.values**2).tolist()
    return spark.createDataFrame(list(zip(svd.genes, energy, strict=True)), f"gene {dict(x.dtypes)['gene']}, energy double").withColumn("energy", F.round("energy", 5))


@_query()
def singular_values(spark, sf_dir):
    """The ten leading singular values of the rows as they are and of the centred ones."""
    from cohortframe.operators import decomposition as D

    x = _logs(spark, sf_dir)
    obs = x.select("obs").distinct()
    rows = D.sparse_rows(x, obs.count(), obs)
    found = [(c, i, float(v)) for c in (False, True) for i, v in enumerate(D.truncated_svd(rows, 10, c).values)]
    return _rounded(spark.createDataFrame(found, "centered boolean, component int, value double"))


@_query()
def basic_clusters(spark, sf_dir):
    """Suppliers clustered by their scores on singular vectors of the most variable genes."""
    from cohortframe.operators import decomposition as D

    x = _logs(spark, sf_dir)
    return D.basic_clusters(x, x.select("obs").distinct())


@_query()
def metagene_redundancy(spark, sf_dir):
    from cohortframe.operators import scorers as S

    x = _logs(spark, sf_dir)
    return _rounded(S.metagene_redundancy(x, x.select("obs").distinct()))


@_query()
def marker_anti_hub(spark, sf_dir):
    """Genes that mark one of the clusters found among the suppliers."""
    from cohortframe.operators import scorers as S

    x = _logs(spark, sf_dir)
    return _rounded(S.marker_anti_hub(x, x.select("obs").distinct()))


@_query(f"""{_DENSE}, {_MOMENTS}, st AS (SELECT obs, obs % 4 AS c FROM o), cs AS (SELECT gene, c, avg(x) AS a, count(*) AS m, sum(x) AS s FROM dn JOIN st USING (obs) GROUP BY ALL), al AS (SELECT gene, sum(x) AS s, count(*) AS n FROM dn GROUP BY ALL),
ct AS (SELECT gene, max((a - (al.s - cs.s) / nullif(n - m, 0)) / (sqrt(variance) + 1e-6)) FILTER (m >= 5 AND n - m >= 5) AS contrast FROM cs JOIN al USING (gene) JOIN mo USING (gene) GROUP BY gene),
t AS (SELECT gene, contrast, prevalence, variance, (row_number() OVER (ORDER BY round(mean, 10), gene) - 1) / greatest(count(*) OVER () - 1, 1) * {_bump('prevalence', 0.55, 0.33)} AS hub, coalesce(contrast, variance) AS mark FROM mo JOIN ct USING (gene)),
r AS (SELECT *, {_z('mark')} + 0.3 * {_z('variance')} - 0.45 * {_z('hub')} AS raw FROM t) SELECT gene, round(contrast, 6) AS contrast, round(prevalence, 6) AS prevalence, round({_z('raw')}, 6) AS score FROM r""")
def state_markers(spark, sf_dir):
    """Genes that mark a given state (suppliers' keys modulo 4)."""
    from cohortframe.operators import scorers as S

    x = _logs(spark, sf_dir)
    obs = x.select("obs").distinct()
    return _rounded(S.marker_anti_hub(x, obs, groups=obs.withColumn("cluster", F.col("obs") % 4)))


@_query(f"{_DENSE} SELECT gene, round(quantile_cont(x, 0.1), 8) AS q0, round(quantile_cont(x, 0.5), 8) AS q1, round(quantile_cont(x, 0.9), 8) AS q2 FROM dn GROUP BY gene")
def gene_quantiles(spark, sf_dir):
    from cohortframe.operators import scorers as S

    x = _logs(spark, sf_dir)
    return _r(S.gene_quantiles(x, x.select("obs").distinct().count(), 0.1, 0.5, 0.9))


@_query(f"""{_DENSE}, {_MOMENTS}, q AS (SELECT gene, quantile_cont(x, 0.95) AS a, quantile_cont(x, 0.75) AS b, quantile_cont(x, 0.5) AS c FROM dn GROUP BY gene),
t AS (SELECT gene, prevalence, a - c AS lift, a - b AS width, {_bump('prevalence', 0.12, 0.16)} AS rare, (prevalence > 0.75)::INT::DOUBLE AS often FROM mo JOIN q USING (gene)),
r AS (SELECT *, {_z('lift')} + 0.65 * {_z('width')} + 0.45 * {_z('rare')} - 0.2 * {_z('often')} AS raw FROM t)
SELECT gene, round(prevalence, 6) AS prevalence, round(lift, 6) AS tail_lift, round(width, 6) AS tail_width, round({_z('raw')}, 6) AS score FROM r""")
def rare_state_tail(spark, sf_dir):
    from cohortframe.operators import scorers as S

    x = _logs(spark, sf_dir)
    return _rounded(S.rare_state_tail(x, x.select("obs").distinct().count()))


@_query(f"""{_DENSE}, {_MOMENTS}, t AS (SELECT gene, prevalence, separation, variance, -(prevalence * ln(prevalence + 1e-8) + (1 - prevalence) * ln(1 - prevalence + 1e-8)) AS h FROM mo), g AS (SELECT *, h * {_bump('prevalence', 0.35, 0.28)} AS gate FROM t),
r AS (SELECT *, 0.75 * {_z('separation')} + 0.65 * {_z('gate')} + 0.2 * {_z('variance')} AS raw FROM g)
SELECT gene, round(prevalence, 6) AS prevalence, round(separation, 6) AS separation, round(h, 6) AS detection_entropy, round({_z('raw')}, 6) AS score FROM r""")
def bimodality_gate(spark, sf_dir):
    from cohortframe.operators import scorers as S

    x = _logs(spark, sf_dir)
    return _rounded(S.bimodality_gate(x, x.select("obs").distinct().count()))


@_query("""WITH m AS (SELECT l_suppkey AS run, avg(l_discount::DOUBLE) AS ari, avg(l_tax::DOUBLE) AS nmi, CASE WHEN l_suppkey % 5 > 0 THEN 2 * avg((l_returnflag = 'A')::INT) - 1 END AS label_silhouette, avg((l_linestatus = 'O')::INT) AS neighbor_preservation, max(l_discount::DOUBLE) AS stability FROM lineitem GROUP BY l_suppkey),
s AS (SELECT *, 0.19 * (coalesce(label_silhouette, 0) + 1) + 0.135 + 0.35 * neighbor_preservation AS structure FROM m)
SELECT run, round(structure, 6) AS structure_score, round(0.38 * ari + 0.28 * nmi + 0.2 * structure + 0.06 * stability, 6) AS reward FROM s""")
def selection_reward(spark, sf_dir):
    """Rewards of runs (suppliers) from stand-in metrics; some silhouettes are null, two metrics are absent."""
    from cohortframe.operators import scorers as S

    share = lambda c: F.avg(c.cast("double"))
    m = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(
        share(F.col("l_discount")).alias("ari"), share(F.col("l_tax")).alias("nmi"), (2 * share(F.col("l_returnflag") == "A") - 1).alias("label_silhouette"),
        share(F.col("l_linestatus") == "O").alias("neighbor_preservation"), F.max(F.col("l_discount").cast("double")).alias("stability"),
    )
    m = m.withColumn("label_silhouette", F.when(F.col("run") % 5 > 0, F.col("label_silhouette")))
    return _rounded(S.selection_reward(m).select("run", "structure_score", "reward"))


# --- side tables ------------------------------------------------------------------------------------


@_query("SELECT 'c' || c_custkey AS obs, c_mktsegment AS label, c_nationkey::VARCHAR AS batch FROM customer")
def sidecar_labels(spark, sf_dir):
    """Labels and batches of customers from a CSV table that Spark writes of them, its columns found by their names."""
    from uuid import uuid4

    from cohortframe.plans.tables import shared_dir
    from cohortframe.sources import annotations as N

    c = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("obs"), "c_mktsegment", "c_nationkey")
    path = f"{shared_dir(spark)}/cohortframe-annotations-{uuid4().hex}"
    c.select(F.col("obs").alias("name"), F.col("c_nationkey").alias("the donor"), F.col("c_mktsegment").alias("Cell.Type")).write.csv(path, header=True)
    return N.sidecars(c.select("obs"), N.read_annotations(spark, path, ","))


# --- the selector ---------------------------------------------------------------------------------


def _selector(spark, sf_dir):
    """Nations are datasets, order priorities methods, '5-LOW' the safe one; figures of customers and orders are features."""
    from cohortframe.operators import selector as S

    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("dataset"))
    c = _table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("k"))
    o = _table(spark, sf_dir, "orders").join(c.select("c_custkey", "dataset"), F.col("o_custkey") == F.col("c_custkey"))
    lines = _table(spark, sf_dir, "lineitem").join(o.select("o_orderkey", "dataset", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    scores = lines.groupBy("dataset", F.col("o_orderpriority").alias("method")).agg(F.round(10 * F.avg(F.col("l_discount").cast("double")), 9).alias("overall"), F.round(10 * F.avg(F.col("l_tax").cast("double")), 9).alias("biology"))
    f = c.groupBy("dataset").agg(F.round(F.avg(F.col("c_acctbal").cast("double")), 9).alias("balance"), F.count("*").cast("double").alias("customers")).join(o.groupBy("dataset").agg(F.round(F.avg(F.col("o_totalprice").cast("double")), 9).alias("price")), "dataset")
    audit = spark.createDataFrame([("1-URGENT", 0.9), ("2-HIGH", 0.6), ("3-MEDIUM", 0.75)], "method string, reliability double").withColumn("admissible", F.lit(True))
    return f.unpivot("dataset", ["balance", "customers", "price"], "feature", "value"), scores, audit, S.Policy(anchor="5-LOW")


_THRESHOLDS = (-0.25, -0.20, -0.15, -0.10, -0.05, 0.0, 0.05, 0.10, 0.15, 0.20)
_DECIDED = f"""WITH cn AS (SELECT c_custkey, n_name AS dataset, c_acctbal::DOUBLE AS bal FROM customer JOIN nation ON n_nationkey = c_nationkey), od AS (SELECT o_orderkey, dataset, o_orderpriority AS method, o_totalprice::DOUBLE AS price FROM orders JOIN cn ON c_custkey = o_custkey),
sc AS (SELECT dataset, method, round(10 * avg(l_discount::DOUBLE), 9) AS overall, round(10 * avg(l_tax::DOUBLE), 9) AS biology FROM lineitem JOIN od ON o_orderkey = l_orderkey GROUP BY ALL),
f AS (SELECT dataset, 'balance' AS feature, round(avg(bal), 9) AS x FROM cn GROUP BY ALL UNION ALL SELECT dataset, 'customers', count(*)::DOUBLE FROM cn GROUP BY ALL UNION ALL SELECT dataset, 'price', round(avg(price), 9) FROM od GROUP BY ALL),
fs AS (SELECT fold, dataset, feature, x FROM f, (SELECT DISTINCT dataset AS fold FROM f)), st AS (SELECT fold, feature, avg(x) AS m, stddev_pop(x) AS s FROM fs WHERE dataset <> fold GROUP BY ALL), z AS (SELECT fold, dataset, feature, (x - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END AS z FROM fs JOIN st USING (fold, feature)),
fr AS (SELECT a.fold, a.dataset AS query, b.dataset, sqrt(sum((a.z - b.z) ** 2)) AS far FROM z a JOIN z b ON a.fold = b.fold AND a.feature = b.feature AND a.dataset <> b.dataset AND b.dataset <> b.fold GROUP BY ALL), nr AS (SELECT *, row_number() OVER (PARTITION BY fold, query ORDER BY far, dataset) AS r FROM fr QUALIFY r <= 5),
vt AS (SELECT fold, query, dataset, (1 / (far + 1e-6)) / greatest(sum(1 / (far + 1e-6)) OVER (PARTITION BY fold, query), 1e-8) AS w FROM nr),
gn AS (SELECT s.dataset, s.method, s.overall, s.biology, a.overall AS ao, a.biology AS ab, s.overall - a.overall AS du, s.biology - a.biology AS db FROM sc s JOIN sc a ON a.dataset = s.dataset AND a.method = '5-LOW'),
au AS (SELECT * FROM (VALUES ('1-URGENT', 0.9::DOUBLE), ('2-HIGH', 0.6::DOUBLE), ('3-MEDIUM', 0.75::DOUBLE)) t(method, reliability)), bk AS (SELECT official, method, coalesce(reliability, 1.0) AS rel FROM (SELECT DISTINCT method FROM sc WHERE method <> '5-LOW') LEFT JOIN au USING (method), (VALUES (true), (false)) o(official) WHERE NOT official OR coalesce(reliability, 1.0) >= 0.7),
mu AS (SELECT official, fold, query, method, rel, sum(w * du) AS mu, sum(w * db) AS mb FROM vt JOIN gn USING (dataset) JOIN bk USING (method) GROUP BY ALL), sd AS (SELECT official, fold, query, method, rel, mu, mb, sqrt(sum(w * (du - mu) ** 2)) AS su, sqrt(sum(w * (db - mb) ** 2)) AS sb FROM mu JOIN vt USING (fold, query) JOIN gn USING (dataset, method) GROUP BY ALL),
rt AS (SELECT *, mu - 0.6 * su AS ul, mb - 0.45 * sb AS bl, round(mu - 0.6 * su + 0.35 * (mb - 0.45 * sb) - 0.2 * greatest(0, 1 - rel), 12) AS route FROM sd), pr AS (SELECT *, row_number() OVER (PARTITION BY official, fold, query ORDER BY route DESC, round(mu, 12) DESC, round(mb, 12) DESC, method) AS r FROM rt QUALIFY r = 1),
ca AS (SELECT official, fold, t, round(avg(CASE WHEN route > t THEN overall ELSE ao END), 12) AS s, round(avg(CASE WHEN route > t THEN du ELSE 0 END), 12) AS u, round(avg(CASE WHEN route > t THEN db ELSE 0 END), 12) AS b FROM pr JOIN gn ON gn.dataset = pr.query AND gn.method = pr.method, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _THRESHOLDS)}]) AS t) WHERE query <> fold GROUP BY ALL),
th AS (SELECT official, fold, t AS threshold, row_number() OVER (PARTITION BY official, fold ORDER BY b >= -0.015 DESC, s DESC, u DESC, b DESC, abs(t), t) AS r FROM ca QUALIFY r = 1),
mn AS (SELECT official, gn.dataset AS fold, gn.method, gn.overall, round((sum(gn.overall) OVER (PARTITION BY official, gn.method) - gn.overall) / (count(*) OVER (PARTITION BY official, gn.method) - 1), 12) AS m FROM gn JOIN bk USING (method)),
bs AS (SELECT official, fold, arg_min(method, (-m, method)) AS best_single_method, arg_min(overall, (-m, method)) AS best_single_overall, arg_min(method, (-overall, method)) AS oracle_method, arg_min(overall, (-overall, method)) AS oracle_overall FROM mn GROUP BY ALL),
dd AS (SELECT pr.official, pr.fold, pr.method AS proposed_method, rel, route, mu, su, ul, mb, sb, bl, threshold, overall AS po, biology AS pb, ao, ab, best_single_method, best_single_overall, oracle_method, oracle_overall FROM pr JOIN th ON th.official = pr.official AND th.fold = pr.fold JOIN gn ON gn.dataset = pr.fold AND gn.method = pr.method JOIN bs ON bs.official = pr.official AND bs.fold = pr.fold WHERE pr.query = pr.fold)"""


@_query(f"""{_DECIDED} SELECT official, fold, proposed_method, round(route, 8) AS route_score, threshold AS route_threshold, round(mu, 8) AS utility_mu, round(ul, 8) AS utility_lcb, round(mb, 8) AS biology_mu, round(bl, 8) AS biology_lcb, best_single_method, oracle_method FROM dd""")
def selector_decisions(spark, sf_dir):
    from cohortframe.operators import selector as S

    t = S.held_out_decisions(*_selector(spark, sf_dir))
    return _r(t.select("official", "fold", "proposed_method", "route_score", "route_threshold", "utility_mu", "utility_lcb", "biology_mu", "biology_lcb", "best_single_method", "oracle_method"))


_SWEEP = f"""{_DECIDED}, gr AS (SELECT c, m, o FROM (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS c), (SELECT unnest([-0.10, -0.05, -0.02, 0.0]::DOUBLE[]) AS m), (SELECT unnest([-0.10, -0.05, 0.0, 0.05, 0.10]::DOUBLE[]) AS o)),
go AS (SELECT *, route > round(threshold + o, 12) AND round(rel / (1 + exp(-6.0 * (route - round(threshold + o, 12) - 0.5 * (su + 0.35 * sb)))), 12) >= c AND round(bl, 12) >= m AS go FROM dd, gr), ch AS (SELECT *, CASE WHEN go THEN po ELSE ao END AS s, CASE WHEN go THEN pb ELSE ab END AS b FROM go),
sw AS (SELECT official AS official_filter_on, c AS confidence_threshold, m AS biology_margin, o AS route_threshold_offset, avg(s) AS mean_overall_score, avg(b) AS mean_biology_proxy, avg(s - ao) AS mean_delta_vs_anchor, avg(s - best_single_overall) AS mean_delta_vs_best_single, avg(oracle_overall - s) AS mean_regret_to_oracle_bank,
min(s - ao) AS worst_dataset_delta, min(b - ab) AS worst_case_biology_delta, avg(go::INT) AS release_coverage, sum(go::INT)::BIGINT AS override_count, count(*) AS dataset_count FROM ch GROUP BY ALL)"""
_SWEPT = ["mean_overall_score", "mean_biology_proxy", "mean_delta_vs_anchor", "mean_delta_vs_best_single", "mean_regret_to_oracle_bank", "worst_dataset_delta", "worst_case_biology_delta", "release_coverage"]
_KEYS = "official_filter_on, confidence_threshold, biology_margin, route_threshold_offset"
_SHOWN = f"{_KEYS}, {', '.join(f'round({c}, 8) AS {c}' for c in _SWEPT)}, override_count, dataset_count"


@_query(f"{_SWEEP} SELECT {_SHOWN} FROM sw")
def coverage_sweep(spark, sf_dir):
    from cohortframe.operators import selector as S

    return _r(S.coverage_sweep(S.held_out_decisions(*_selector(spark, sf_dir))))


@_query(f"""{_SWEEP}, fn AS (SELECT *, mean_delta_vs_anchor >= 0 AND worst_case_biology_delta >= -0.06 AS fine FROM sw), w AS (SELECT *, round(mean_delta_vs_anchor + 0.35 * mean_biology_proxy - 0.10 * release_coverage - 0.25 * mean_regret_to_oracle_bank, 12) AS worth FROM fn WHERE fine OR NOT (SELECT bool_or(fine) FROM fn))
SELECT {_SHOWN}, round(worth, 8) AS sweet_spot_score FROM w ORDER BY worth DESC, round(mean_delta_vs_anchor, 12) DESC, round(mean_biology_proxy, 12) DESC, {_KEYS} LIMIT 10""")
def coverage_sweet_spots(spark, sf_dir):
    from cohortframe.operators import selector as S

    return _r(S.sweet_spots(S.coverage_sweep(S.held_out_decisions(*_selector(spark, sf_dir)))))


@_query(f"""{_SWEEP}, rd AS (SELECT *, round(mean_delta_vs_anchor, 12) AS a, round(worst_case_biology_delta, 12) AS b, round(release_coverage, 12) AS c FROM sw)
SELECT {_SHOWN} FROM rd x WHERE NOT EXISTS (SELECT 1 FROM rd y WHERE y.a >= x.a AND y.b >= x.b AND y.c >= x.c AND (y.a > x.a OR y.b > x.b OR y.c > x.c))""")
def coverage_frontier(spark, sf_dir):
    from cohortframe.operators import selector as S

    return _r(S.risk_frontier(S.coverage_sweep(S.held_out_decisions(*_selector(spark, sf_dir)))))




# --- graph embedding -----------------------------------------------------------------------------


@_query()
def graph_embedding(spark, sf_dir):
    """Vectors are nodes, joined to the next and the last of their sample by number; no SQL, as the fit draws views."""
    from cohortframe.operators import contrast as C

    nodes = _vectors(spark, sf_dir).where("vector is not null").select("sample_id", "obs_id", "condition", F.col("vector").alias("features"))
    ends = nodes.select("sample_id", F.col("obs_id").alias("src"), F.explode(F.array(F.col("obs_id") - 8, F.col("obs_id") + 8)).alias("dst"))
    known = nodes.select("sample_id", F.col("obs_id").alias("dst"))
    edges = ends.join(known, ["sample_id", "dst"], "left_semi")
    edges = edges.join(edges.groupBy("sample_id", "src").agg(F.count("*").alias("n")), ["sample_id", "src"]).select("sample_id", "src", "dst", (1.0 / F.col("n")).alias("weight"))
    out, _ = C.graph_embedding(nodes, edges)
    return out.select("sample_id", "obs_id", F.transform("embedding", lambda v: F.round(v, 6)).alias("embedding"))
