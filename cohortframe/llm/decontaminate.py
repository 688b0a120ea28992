"""Benchmark decontamination: size-partitioned MinHash containment search, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import materialize


def words_of(text: Column, lower: bool = True) -> Column:
    """The words of a text (runs of bytes other than 0x20, 0x09-0x0D); null: an empty array.

    To split at each blank and drop what is empty is faster than to split at runs of blanks.
    """
    words = F.array_remove(F.split(F.lower(text) if lower else text, "[ \\t-\\r]"), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def _starts(words: Column, size: int) -> Column:
    """First positions of the shingles; fewer words than a shingle: the whole sequence is one."""
    n = F.size(words)
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _hashes(hashes: Column, size: int) -> Column:
    """A 64-bit hash of each shingle, from the hashes of its words."""
    return F.transform(_starts(hashes, size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))


def _each(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _strings(words: Column, size: int) -> Column:
    """The distinct shingles, words joined by a space."""
    return F.array_distinct(F.transform(_starts(words, size), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)])))


def _small(df: DataFrame, rows: int, size: int) -> DataFrame:
    """``df``, to be broadcast if it has no more than ``rows`` rows; else both sides are shuffled.

    The hint keeps Spark from guessing: it reckons the size of an exploded table by that of its input.
    """
    return F.broadcast(df) if size <= rows else df.hint("merge")


def signatures(items: DataFrame, threshold: float, size: int) -> DataFrame:
    """(item_key, h): MinHash signatures of the items.

    Items are partitioned by their number n of distinct shingles into classes [2**c, 2**(c+1)).
    A document that holds at least ceil(threshold * n) of them lacks at most n - ceil(threshold * n), so of
    any one more than that it holds one.  Each class keeps that many of the smallest
    hashes, reckoned at its largest n, which is enough for each n of the class.
    """
    most = F.pow(2.0, F.floor(F.log2("n")) + 1) - 1
    keep = most - F.ceil(F.lit(threshold) * most - 1e-9) + 1
    h = F.array_sort(F.array_distinct(_hashes(F.col("each"), size)))
    return items.withColumn("each", _each(F.col("words"))).select("item_key", F.explode(F.slice(h, 1, keep.cast("int"))).alias("h"))


def containment(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """:func:`held_items` without the hash of the text."""
    return held_items(docs, items, threshold, shingle, broadcast_rows).drop("text_key")


def held_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, text_key, item_id, n_shingles, n_shared, containment): documents that hold a benchmark item.

    Texts are compared in lower case by the set of their ``shingle``-word shingles; an item is
    held if ``n_shared / n_shingles >= threshold``.  An item of fewer words is one shingle of all its
    words.  Candidates come from the signatures, which miss nothing; each candidate document is then
    compared shingle by shingle.  Items or documents that are null or blank match nothing.
    One row comes out for each pair of distinct (doc_id, text) and (item_id, text).
    Tables of more than ``broadcast_rows`` rows are shuffled instead of broadcast.  A null doc_id or item_id is a value;
    other columns are ignored; an empty table on either side gives an empty one.
    """
    items = items.select(F.col("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = items.withColumn("item_key", F.struct("item_id", F.xxhash64("words"))).withColumn("shingles", _strings(F.col("words"), shingle)).withColumn("n", F.size("shingles").cast("long"))
    items = materialize(items.withColumn("item_key", F.xxhash64("item_key")), "items")
    signed = materialize(signatures(items, threshold, shingle).distinct(), "signatures")

    texts = docs.select("doc_id", F.col("text").alias("doc_text"))
    hashed = texts.select("doc_id", F.xxhash64("doc_text").alias("doc_key"), words_of(F.col("doc_text")).alias("words"))
    hashed = hashed.select("doc_id", "doc_key", _each(F.col("words")).alias("each"))
    probes = hashed.select("doc_id", "doc_key", F.explode(_hashes(F.col("each"), shingle)).alias("h"))
    wanted = signed.select("h").distinct()
    hits = probes.join(_small(wanted, broadcast_rows, signed.count()), "h", "left_semi").select("doc_id", "doc_key").distinct()
    hits = materialize(hits, "candidates")

    same = (F.col("doc_id").eqNullSafe(F.col("hit_id"))) & (F.xxhash64("doc_text") == F.col("hit_key"))
    few = _small(hits.select(F.col("doc_id").alias("hit_id"), F.col("doc_key").alias("hit_key")), broadcast_rows, hits.count())
    near = texts.join(few, same, "left_semi").dropDuplicates(["doc_id", "doc_text"])
    # the words are a column of their own: inside the lambda the text would be split again for each shingle
    near = near.select("doc_id", F.xxhash64("doc_text").alias("doc_key"), words_of(F.col("doc_text")).alias("words"))
    near = near.select("doc_id", "doc_key", F.explode(_strings(F.col("words"), shingle)).alias("s"))
    listed = items.select("item_key", "item_id", "n", F.explode("shingles").alias("s"))
    total = items.select(F.sum("n")).first()[0] or 0
    shared = near.join(_small(listed, broadcast_rows, total), "s").groupBy("doc_id", "doc_key", "item_id", "item_key", "n").agg(F.count("*").alias("n_shared"))
    out = shared.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n") - 1e-9))
    return out.select("doc_id", F.col("doc_key").alias("text_key"), "item_id", F.col("n").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark item; columns as given, whatever their names."""
    found = materialize(held_items(docs, items, threshold, shingle, broadcast_rows).select("doc_id", "text_key").distinct(), "leaks")
    names = ["_id", "_key"]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    few = _small(found.toDF(*names), broadcast_rows, found.count())
    return docs.join(few, F.col("doc_id").eqNullSafe(F.col(names[0])) & (F.xxhash64("text") == F.col(names[1])), "left_anti")
