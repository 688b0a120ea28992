"""Sample by motif counts, densely filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DATASET = ["dataset_id", "dataset_name"]
_SAMPLE = ["sample_id", "condition"]
_MOTIF = ["motif_id", "motif_label"]


def sample_motif_abundance(spots: DataFrame) -> DataFrame:
    """One row per sample and motif of a dataset: the sample's spots, the motif's and their fraction.

    A motif that a sample lacks has zero spots.  One aggregation with map-side combine reads
    the spots; samples, motifs and totals come from its small result.
    """
    counts = spots.groupBy(*_DATASET, *_SAMPLE, *_MOTIF).agg(F.count("*").alias("motif_spots"))
    samples = counts.groupBy(*_DATASET, *_SAMPLE).agg(F.sum("motif_spots").alias("sample_spots"))
    motifs = counts.select(*_DATASET, *_MOTIF).distinct()
    dense = samples.join(motifs, _DATASET).join(counts, _DATASET + _SAMPLE + _MOTIF, "left")
    n = F.coalesce("motif_spots", F.lit(0))
    return dense.select(*_DATASET, *_SAMPLE, *_MOTIF, "sample_spots", n.alias("motif_spots"), F.when(F.col("sample_spots") > 0, n / F.col("sample_spots")).otherwise(0.0).alias("motif_fraction"))
