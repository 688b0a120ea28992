"""Readers and writers: observations, sparse matrices, result tables.

Readers take what Spark opens, so paths may lie in any store; schemas are given, never inferred from data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortframe.sources.annotations import read_names

#: Columns of observations and what stands in for a missing one.
OBSERVATIONS = {"obs_id": ("string", None), "sample_id": ("string", "sample_0"), "condition": ("string", "unknown"), "cell_type": ("string", "unassigned"), "cluster": ("string", ""), "spatial_x": ("double", None), "spatial_y": ("double", None), "n_counts": ("double", 0.0), "n_genes_by_counts": ("double", 0.0)}


def observations(df: DataFrame) -> DataFrame:
    """Observation columns with their types; missing columns and empty cells get the stand-ins, numbers that are none become null or zero."""
    out = []
    for name, (kind, default) in OBSERVATIONS.items():
        c = F.col(name) if name in df.columns else F.lit(None)
        c = c.try_cast(kind)
        if kind == "double":
            c = F.when(~F.isnan(c), c)
        out.append((F.coalesce(c, F.lit(default)) if default is not None else c).alias(name))
    return df.select(*out, *[c for c in df.columns if c not in OBSERVATIONS])


def read_observations(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Observations from Parquet, ORC, JSON or CSV and TSV with a header."""
    if kind in ("csv", "tsv"):
        return observations(spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ","))
    return observations(spark.read.format(kind).load(path))


def read_matrix_market(spark: SparkSession, path: str, genes: str, barcodes: str) -> DataFrame:
    """(obs, gene, value) of a coordinate file with one name per line in two side files; explicit zeros are dropped.

    Names are numbered by their place in the file; blank lines of side files do not count.  A coordinate occurs once in a file, so at most one entry reads like the line of sizes.
    """

    def names(p: str, label: str) -> DataFrame:
        return read_names(spark, p).select((F.col("_position") + 1).alias(f"_{label}"), F.col("obs").alias(label))

    body = spark.read.text(path).where(~F.col("value").startswith("%")).select(F.split(F.btrim("value"), r"\s+").alias("p")).where(F.size("p") >= 2)
    e = body.select(F.col("p")[0].cast("long").alias("_gene"), F.col("p")[1].cast("long").alias("_obs"), F.get("p", F.lit(2)).cast("double").alias("value"))
    e = e.withColumn("value", F.coalesce("value", F.lit(1.0)))  # a pattern file names places only
    g, b = names(genes, "gene"), names(barcodes, "obs")
    # the first line that is no comment holds the sizes; it comes first by its place in the file, not by what it says
    head = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")).where(~F.col("value").startswith("%") & (F.btrim("value") != ""))
    head = head.agg(F.min_by("value", "at").alias("v")).select(F.split(F.btrim("v"), r"\s+").alias("h")).first()["h"]
    size = [F.lit(int(head[0])), F.lit(int(head[1])), F.lit(float(head[2]))]
    same = (F.col("_gene") == size[0]) & (F.col("_obs") == size[1]) & (F.col("value") == size[2])
    # an entry that reads like the line of sizes stays: of such lines one is dropped
    twins = e.where(same).count() - 1
    rest = e.where(~same)
    e = rest.unionByName(e.where(same).limit(twins)) if twins > 0 else rest
    return e.join(g, "_gene").join(b, "_obs").where("value != 0").select("obs", "gene", "value")


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write a result; an existing one is replaced.  CSV gets a header."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path, header=True) if kind == "csv" else w.format(kind).save(path)
