"""Side tables of observations: rows numbered as their file has them, key column found, columns guessed by name, values aligned to observations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.plans.tables import materialize

#: Names of columns that hold labels, and those that hold batches, best first.
LABELS = ("cell type", "cell_type", "cell label", "cell_label", "celltype", "label", "labels", "annotation", "annot", "clusters", "cluster", "cluster_id")
BATCHES = ("batch", "batches", "sample_id", "sample id", "donor_id", "donor", "individual", "patient", "subject", "library", "lane")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` as just read from text or CSV files, with ``_position``: the place from 0 in the order of the files' names and of the lines in them.

    Tasks number what they read of a part of a file; only the parts, one row each, are put in order.
    """
    read = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    read = materialize(read, "lines")
    parts = read.groupBy("_file", "_start").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    # one row per part of a file
    before = F.sum("_n").over(W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    out = read.join(parts.withColumn("_before", before), ["_file", "_start"])
    return out.withColumn("_position", F.col("_before") + F.col("_at") - F.col("_from")).drop("_file", "_start", "_at", "_from", "_n", "_before")


def read_names(spark: SparkSession, path: str, column: int = 0) -> DataFrame:
    """(_position, obs): one name per line, the given column of those separated by tabs; blank lines are skipped."""
    lines = numbered(spark.read.text(path)).where(F.btrim("value") != "")
    name = F.get(F.split(F.regexp_replace("value", r"\r$", ""), "\t"), F.lit(column))
    return _closed(lines.select("_position", name.alias("obs")))


def _closed(rows: DataFrame) -> DataFrame:
    """Positions without gaps: blocks of ten thousand places are counted, rows ranked within theirs."""
    rows = rows.withColumn("_block", F.floor(F.col("_position") / 10_000))
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n"))
    rank = F.row_number().over(W.partitionBy("_block").orderBy("_position")) - 1
    return rows.join(sizes, "_block").withColumn("_position", F.col("_before") + rank).drop("_block", "_n", "_before")


def read_annotations(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """(_position, key, ...): a table with a header, its cells as text; TSV and TXT are parted by tabs, others by commas.

    The first column is the key where there are two or more and under half of its cells are numbers; it then is no value column.
    Otherwise rows are called ``cell_0``, ``cell_1``, ... by their place.  Of rows with one key the first stays; ``_position`` is the place before that.
    An empty table is an error.
    """
    delimiter = delimiter or ("\t" if path.lower().endswith((".tsv", ".txt")) else ",")
    raw = spark.read.csv(path, header=True, sep=delimiter)
    first, rest = raw.columns[0], raw.columns[1:]
    table = numbered(raw)
    number = F.col(f"`{first}`").try_cast("double")
    told = table.agg(F.count("*").alias("n"), F.count(F.when(number.isNotNull() & ~F.isnan(number), 1)).alias("numbers")).first()
    if not told["n"]:
        raise ValueError(f"no rows in {path}")
    if rest and told["numbers"] < 0.5 * told["n"]:
        keyed = table.select("_position", F.coalesce(F.col(f"`{first}`"), F.lit("nan")).alias("key"), *[f"`{c}`" for c in rest])
    else:
        keyed = table.select("_position", F.format_string("cell_%d", "_position").alias("key"), *[f"`{c}`" for c in raw.columns])
    # key sizes are one almost everywhere; a key on very many rows meets as partial aggregates, not as a window
    firsts = keyed.groupBy("key").agg(F.min("_position").alias("_position"))
    return keyed.join(firsts, ["key", "_position"]).select("_position", "key", *[f"`{c}`" for c in keyed.columns if c not in ("_position", "key")])


def _plain(name: str) -> str:
    return " ".join(re.sub(r"[\W_]+", " ", name.lower()).split())


def guess_column(columns: list[str], names: tuple[str, ...]) -> str | None:
    """The column that fits the best of ``names``: as it is but for case, else but for punctuation, else as one that holds the name.

    Every column is looked at for the first way, then for the second, then for the third; names go before columns, and the first column wins.
    """
    fits = (lambda c, n: c.lower() == n, lambda c, n: _plain(c) == _plain(n), lambda c, n: _plain(n) in _plain(c))
    return next((c for fit in fits for n in names for c in columns if fit(c, n)), None)


def guess_annotation_columns(columns: list[str]) -> tuple[str | None, str | None]:
    """The columns of labels and of batches."""
    return guess_column(columns, LABELS), guess_column(columns, BATCHES)


def aligned(observations: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """(obs, value): a column of an annotation table for every one of ``observations`` (_position, obs).

    By key, if the table has all of them; else by place, if both have as many rows; else that is an error.  Nulls stay null.
    """
    if column not in table.columns:
        raise ValueError(f"no column {column!r} among {table.columns[2:]}")
    value = F.col(f"`{column}`").alias("value")
    if observations.join(table.select(F.col("key").alias("obs")), "obs", "left_anti").isEmpty():
        return observations.select("obs").join(table.select(F.col("key").alias("obs"), value), "obs")
    if observations.count() != table.count():
        raise ValueError(f"cannot align column {column!r}: keys are missing and numbers of rows differ")
    places = _closed(table.select("_position", value))
    return _closed(observations.select("_position", "obs")).join(places, "_position").select("obs", "value")


def single_column(table: DataFrame, name: str) -> str:
    """The value column of a table made for one: its only one, else the first that is not called ``name``, else the last."""
    values = table.columns[2:]
    if not values:
        raise ValueError("no value column")
    return values[0] if len(values) == 1 else next((c for c in values if c != name), values[-1])


def sidecars(observations: DataFrame, obs: DataFrame | None = None, labels: DataFrame | None = None, batches: DataFrame | None = None, labels_col: str | None = None, batches_col: str | None = None) -> DataFrame:
    """(obs, label, batch): from a table of both, in the named columns or those that their names tell, or from a table of each, which goes first.

    What no table gives is null.
    """
    out = observations.select("obs")
    guessed = guess_annotation_columns(obs.columns[2:]) if obs is not None else (None, None)
    for own, named, guess, name in ((labels, labels_col, guessed[0], "label"), (batches, batches_col, guessed[1], "batch")):
        column = named or guess
        if own is not None:
            found = aligned(observations, own, single_column(own, named or name))
        elif obs is not None and column:
            found = aligned(observations, obs, column)
        else:
            found = None
        out = out.withColumn(name, F.lit(None).cast("string")) if found is None else out.join(found.withColumnRenamed("value", name), "obs")
    return out
