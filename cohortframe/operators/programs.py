"""What a motif is made of: labels, expression programs, markers and gene sets.

``counts``: obs, gene, value (stored values only); ``groups``: obs, group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.functions import special
from cohortframe.operators import neighborhood as N
from cohortframe.operators.decisions import marker_genes
from cohortframe.operators.decomposition import scores, sparse_rows, truncated_svd
from cohortframe.operators.vectors import variable_genes
from cohortframe.plans.ship import ship
from cohortframe.plans.tables import materialize


def quantile_state(value: Column, low: Column, high: Column, labels: tuple[str, str, str]) -> Column:
    return F.when(value <= low, labels[0]).when(value <= high, labels[1]).otherwise(labels[2])


def motif_labels(spots: DataFrame, shares: DataFrame, entropy: DataFrame, density: DataFrame, motif: str = "motif_id") -> DataFrame:
    """(motif_id, motif_label): the two leading cell types around a motif's spots, and its density and entropy against the thirds over motifs.

    ``shares``: src, label, share; ``entropy``: src, entropy; ``density``: src, area_density.  What a spot lacks counts as zero.  Of
    equal means the smaller name leads; a single cell type is named twice.
    """
    m = spots.select(F.col("obs_id").alias("src"), F.col(motif).alias("motif_id"))
    sums = shares.join(m, "src").groupBy("motif_id", "label").agg(F.sum("share").alias("s"))
    means = m.join(entropy.select("src", "entropy"), "src").join(density.select("src", "area_density"), "src").groupBy("motif_id").agg(F.avg("entropy").alias("e"), F.avg("area_density").alias("d"))
    return _motif_names(m.groupBy("motif_id").agg(F.count("*").alias("n")), sums, means)


def neighborhood_labels(spots: DataFrame, k: int, label: str, categories: int, motif: str = "motif_id") -> DataFrame:
    """:func:`motif_labels` of the ``k`` nearest: neighbours' lists carry labels and motifs, so only sums by motif are shuffled.

    Spots have one sample each; a null label has a share in no motif.
    """
    rows = spots.withColumn("_motif", F.col(motif)).withColumn("_label", F.col(label))
    t = materialize(N.list_statistics(N.knn_lists(rows, k, carry=("_label", "_motif")), rows, "_label", categories, (k,), carry=("_motif",)), "labels")
    t = t.withColumnRenamed("_motif", "motif_id")
    sums = t.select("motif_id", F.explode("shares").alias("e")).groupBy("motif_id", "e.label").agg(F.sum("e.share").alias("s"))
    means = t.groupBy("motif_id").agg(F.avg("entropy").alias("e"), F.avg("area_density").alias("d"))
    return _motif_names(t.groupBy("motif_id").agg(F.count("*").alias("n")), sums, means)


def _motif_names(n: DataFrame, sums: DataFrame, means: DataFrame) -> DataFrame:
    top = sums.join(n, "motif_id").withColumn("s", F.round(F.col("s") / F.col("n"), 12))
    top = top.withColumn("r", F.row_number().over(W.partitionBy("motif_id").orderBy(F.desc("s"), "label"))).where("r <= 2")
    names = top.groupBy("motif_id").agg(F.max(F.when(F.col("r") == 1, F.col("label"))).alias("one"), F.max(F.when(F.col("r") == 2, F.col("label"))).alias("two"))
    cuts = means.agg(*[F.percentile(c, q).alias(f"{c}{i}") for c in "ed" for i, q in ((1, 0.33), (2, 0.66))])
    out = names.join(means, "motif_id").crossJoin(F.broadcast(cuts))
    state = F.concat_ws(" ", quantile_state(F.col("d"), F.col("d1"), F.col("d2"), ("sparse", "mixed", "dense")), quantile_state(F.col("e"), F.col("e1"), F.col("e2"), ("lowE", "midE", "highE")))
    return out.select("motif_id", F.concat(F.col("one"), F.lit(" + "), F.coalesce("two", "one"), F.lit(" | "), state).alias("motif_label"))


def expression_programs(expression: DataFrame, n_obs: int, components: int = 6, top: int = 256, loadings: int = 12) -> tuple[DataFrame, DataFrame]:
    """((obs, component, score), (component, explained_variance_ratio, top_genes)): the leading singular vectors over the most variable genes.

    Observations without values of those genes have no scores.  A component's sign makes its largest loading positive.  The ratio
    is the variance of a component's scores over that of all chosen genes.
    """
    spark = expression.sparkSession
    rows = sparse_rows(expression, n_obs, genes=variable_genes(expression, n_obs, top))
    svd = truncated_svd(rows, max(2, min(components, n_obs - 1, len(rows.genes) - 1)))
    # the table of rows stays: the scores are read from it
    out = scores(rows, svd).select("obs", F.posexplode("vector").alias("c", "score")).select("obs", F.format_string("program_%02d", "c").alias("component"), "score")
    ratio = np.maximum(svd.values**2 / n_obs - (svd.means @ svd.loadings) ** 2, 0.0) / max(svd.variances.sum(), 1e-300)
    lead = [";".join(str(rows.genes[i]) for i in np.argsort(-np.abs(v), kind="stable")[:loadings]) for v in svd.loadings.T]
    return out, spark.createDataFrame([(f"program_{c:02d}", float(x), g) for c, (x, g) in enumerate(zip(ratio, lead, strict=True))], "component string, explained_variance_ratio double, top_genes string")


#: Beginnings of gene names that tell little.
DULL = ("AC", "AL", "AP", "LINC", "MIR", "MT-", "RN7", "RNU", "SNOR", "CTD")


def top_markers(counts: DataFrame, groups: DataFrame, group: str, top: int = 8) -> DataFrame:
    """(gene, log2_fold_change, delta_detected_fraction, position): the leading markers of a group.

    Valid are genes of mean 0.05 and detected share 0.10 inside, detected more often inside by 0.02, with a plain name of at most 15
    letters.  Of the ``8 * top`` best by score those with a positive fold change are kept, ``top`` of them.  score = log2 fold
    change + 0.6 * difference of detected shares + 0.15 * log1p of the mean inside; ties by name.
    """
    t = marker_genes(counts, groups, group).withColumn("delta", F.col("detected_in") - F.col("detected_out")).withColumn("name", F.col("gene").cast("string"))
    plain = (F.length("name") <= 15) & ~F.col("name").endswith("-AS1") & ~F.col("name").endswith("-AS2")
    for d in DULL:
        plain = plain & ~F.col("name").startswith(d)
    t = t.where((F.col("mean_in") >= 0.05) & (F.col("detected_in") >= 0.10) & (F.col("delta") >= 0.02) & plain)
    t = t.withColumn("score", F.col("log2_fold_change") + 0.60 * F.col("delta") + 0.15 * F.log1p("mean_in"))
    best = t.orderBy(F.desc("score"), "name").limit(8 * top).where("log2_fold_change > 0").orderBy(F.desc("score"), "name").limit(top)
    return best.select("gene", "log2_fold_change", F.col("delta").alias("delta_detected_fraction"), F.row_number().over(W.orderBy(F.desc("score"), "name")).alias("position"))


#: Gene sets that every dataset is tested for, and those of brain and of tumour datasets.
COMMON_SETS = {"hypoxia_stress": "CA9 VEGFA LDHA SLC2A1 BNIP3 HILPDA PDK1", "immune_lymphocyte": "CD3D CD3E IL7R LTB NKG7 CCL5 TRBC1 TRBC2", "myeloid_inflammation": "TYROBP AIF1 C1QA C1QB C1QC LST1 FCER1G CTSB"}
BRAIN_SETS = {
    "upper_layer_neuron": "RELN CUX1 CUX2 RORB LAMP5 SATB2 POU3F2", "deep_layer_neuron": "BCL11B FEZF2 TLE4 FOXP2 TBR1 CRYM PCP4 ETV1", "white_matter_oligodendrocyte": "MBP MOBP PLP1 MAG MOG OPALIN CLDN11 CNP",
    "astrocyte_reactive": "GFAP AQP4 SLC1A2 ALDH1L1 VIM CD44 FABP7", "synaptic_neuronal": "SNAP25 SYT1 CAMK2A RBFOX3 STMN2 NRGN SLC17A7",
}
TUMOUR_SETS = {
    "epithelial_tumor": "EPCAM KRT8 KRT18 KRT19 KRT17 KRT14 TACSTD2 MSLN", "stromal_ecm": "COL1A1 COL1A2 COL3A1 DCN LUM SPARC ACTA2 TAGLN THY1", "adipose_program": "PLIN1 FABP4 ADIPOQ LPL CFD CIDEA", "proliferation": "MKI67 TOP2A UBE2C CENPF TYMS STMN1",
}


def gene_sets(spark: SparkSession, dataset_id: str) -> DataFrame:
    """(pathway, gene) for a dataset."""
    sets = COMMON_SETS | (BRAIN_SETS if "gse220442" in dataset_id else TUMOUR_SETS)
    return spark.createDataFrame([(p, g) for p, genes in sets.items() for g in genes.split()], "pathway string, gene string")


def enrichment(markers: DataFrame, universe: DataFrame, sets: DataFrame) -> DataFrame:
    """(pathway, overlap_genes, n_overlap, odds_ratio, pvalue): gene sets that share a marker, by Fisher's exact test for more.

    Names are compared in capitals; genes of a set that the universe lacks do not count; an infinite ratio is null.
    """
    ship(markers.sparkSession)
    up = lambda df: df.select(F.upper(F.col("gene").cast("string")).alias("gene")).where("gene is not null and gene != ''").distinct()
    q, u = up(markers).withColumn("hit", F.lit(1)), up(universe)
    s = sets.select("pathway", F.upper("gene").alias("gene")).distinct().join(u, "gene").join(q, "gene", "left")
    s = s.groupBy("pathway").agg(F.count("*").alias("k"), F.count("hit").alias("a"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("hit") == 1, F.col("gene")))), ",").alias("overlap_genes")).where("a > 0")
    sizes = q.agg(F.count("*").alias("q")).crossJoin(u.agg(F.count("*").alias("u"))).crossJoin(u.join(q, "gene").agg(F.count("*").alias("qu")))
    t = s.crossJoin(F.broadcast(sizes)).withColumns({"b": F.greatest(F.col("q") - F.col("a"), F.lit(0)), "c": F.col("k") - F.col("a"), "d": F.greatest(F.col("u") - F.col("k") - F.col("qu") + F.col("a"), F.lit(0))})

    @F.pandas_udf("double")
    def greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([special.fisher_exact(x, "greater") for x in zip(a, b, c, d)], dtype="float64")

    ratio = F.col("a") * F.col("d") / F.when(F.col("b") * F.col("c") > 0, F.col("b") * F.col("c"))
    return t.select("pathway", "overlap_genes", F.col("a").alias("n_overlap"), ratio.alias("odds_ratio"), greater("a", "b", "c", "d").alias("pvalue"))


def overlap_bucket(**members: Column) -> Column:
    """The names of the sets that hold a gene, joined by +, in the order given."""
    return F.concat_ws("+", *[F.when(c, n) for n, c in members.items()])
