"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortframe.plans.ship import ship

#: While a table is written: shuffle files are deleted as soon as the query ends, and rows, which may hold whole texts, go to
#: Python a few at a time, for every task of an executor holds a batch on either side.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"}

#: Bytes of a row group: a writer holds one for every task.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder below its warehouse; on a
    cluster there is no folder that is safe to guess, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    spark.conf.set("spark.checkpoint.dir", f"{warehouse}/_shared")
    return f"{warehouse}/_shared"


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.  The write's shuffle
    files go when it ends, so the steps of an operator do not add up on disk.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/cohortframe-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    for f in schema.fields:
        f.nullable = True
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    out = spark.read.schema(schema).parquet(path)
    out._cohortframe_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote."""
    path = getattr(df, "_cohortframe_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
