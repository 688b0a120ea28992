"""Fill-in-middle: documents cut in three at seeded token boundaries, from an index of distinct texts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import materialize, ship

#: The marks that stand before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_INDEX = pa.struct([("n", pa.int64()), ("chars", pa.int64()), ("bounds", pa.binary())])
_CUT = pa.struct([("prefix", pa.int64()), ("upto", pa.int64())])
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)


def boundaries(text: str) -> np.ndarray:
    """Where each token ends, in code points; a token is a run of ASCII letters or one other code point."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((code | 32) - np.uint32(97) < 26) & (code < 128)
    inside = letter.copy()
    inside[:-1] &= letter[1:]
    inside[-1:] = False
    return np.flatnonzero(~inside) + 1


def _low_bits(n: int, upto: int) -> int:
    return max(0, (upto // n).bit_length() - 1) if n else 0


def elias_fano(values: np.ndarray, upto: int) -> bytes:
    """Increasing values of at most ``upto``: low bits side by side, then high parts as gaps in unary."""
    n = len(values)
    if not n:
        return b""
    low = _low_bits(n, upto)
    bits = (values[:, None] >> np.arange(low)) & 1
    unary = np.zeros(n + (upto >> low) + 1, np.uint8)
    unary[(values >> low) + np.arange(n)] = 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes() + np.packbits(unary, bitorder="little").tobytes()


class EliasFano:
    """Reads single values of an :func:`elias_fano` list without unpacking it."""

    def __init__(self, data: bytes, n: int, upto: int) -> None:
        self.n, self.low = n, _low_bits(n, upto)
        cut = -(-n * self.low // 8)
        self.lower, self.unary = data[:cut], np.frombuffer(data, np.uint8, offset=cut)
        self.before = np.concatenate(([0], np.cumsum(_ONES[self.unary])))

    def select(self, k: int) -> int:
        """Value number ``k``, from 1; number 0 is 0."""
        if k == 0:
            return 0
        byte = int(np.searchsorted(self.before, k, "left")) - 1
        ones = np.flatnonzero(np.unpackbits(self.unary[byte : byte + 1], bitorder="little"))
        high = 8 * byte + int(ones[k - 1 - int(self.before[byte])]) - (k - 1)
        at = (k - 1) * self.low
        rest = int.from_bytes(self.lower[at // 8 : (at + self.low + 7) // 8], "little") >> (at % 8)
        return (high << self.low) | (rest & ((1 << self.low) - 1))


def _indexed(texts: pa.Array) -> pa.Array:
    rows = []
    for t in texts.to_pylist():
        ends = boundaries(t)
        chars = int(ends[-1]) if len(ends) else 0
        rows.append({"n": len(ends), "chars": chars, "bounds": elias_fano(ends, chars)})
    return pa.array(rows, _INDEX)


def _selected(index: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    rows = []
    for r, x, y in zip(index.to_pylist(), first.to_pylist(), second.to_pylist(), strict=True):
        bounds = EliasFano(r["bounds"], r["n"], r["chars"])
        rows.append({"prefix": bounds.select(min(x, y)), "upto": bounds.select(max(x, y))})
    return pa.array(rows, _CUT)


def _draw(seed: int, k: int) -> Column:
    """Group ``k`` of eight hexadecimal digits of the hash of seed and doc_id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    A text of ``n`` tokens is cut at two of its n + 1 boundaries, which the hash of ``seed`` and doc_id names.  ``rate`` per cent of the
    texts are rearranged, of those ``spm`` per cent with the suffix first.  An empty text, or one that holds a mark, stays plain.

    A text's boundaries are one Elias-Fano list.  Texts whose 64-bit hash no other row has are distinct; their list is made where
    they are read, so they are never shuffled.  The others are grouped by hash and content, one list is made for each distinct text and
    written, and the list is joined back to its documents by hash and content; adaptive execution splits a text with very many
    documents.  Hashes that repeat are broadcast up to ``broadcast_rows``, beyond that they are joined by merging.

    Null texts are empty; a null doc_id is drawn for as no digits; repeated rows give a row each; other columns are ignored; an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    again = materialize(rows.groupBy("text_key").agg(F.count("*").alias("copies")).where("copies > 1").select("text_key"), "repeated-texts")
    few = F.broadcast(again) if again.count() <= broadcast_rows else again.hint("merge")
    index, select = F.arrow_udf(_indexed, "struct<n: long, chars: long, bounds: binary>"), F.arrow_udf(_selected, "struct<prefix: long, upto: long>")

    alone = rows.join(few, "text_key", "left_anti").withColumn("index", index("text"))
    shared = rows.join(few, "text_key", "left_semi")
    texts = materialize(shared.groupBy("text_key", "text").agg(F.count("*").alias("copies")).withColumn("index", index("text")), "distinct-texts")
    joined = shared.join(texts.select("text_key", "text", "index"), ["text_key", "text"])

    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.col("text").contains(m)
    plain = (F.col("text") == "") | marked | (_draw(seed, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(seed, 3) % 100 < spm, "spm").otherwise("psm")
    units = F.col("index.n") + 1
    cut = alone.select("doc_id", "text", "index").unionByName(joined.select("doc_id", "text", "index"))
    cut = cut.select("doc_id", "text", F.col("index.n").alias("n"), form.alias("form"), select("index", _draw(seed, 0) % units, _draw(seed, 1) % units).alias("cut"))
    to_int = [F.col(c).cast("int") for c in ("cut.prefix", "cut.upto")]
    prefix, middle, suffix = F.substring("text", F.lit(1), to_int[0]), F.substring("text", to_int[0] + 1, to_int[1] - to_int[0]), F.substring("text", to_int[1] + 1, F.lit((1 << 31) - 1) - to_int[1])
    p, s, m = map(F.lit, MARKS)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    moved = F.col("form") != "plain"
    return cut.select("doc_id", "n", "form", F.when(moved, F.col("cut.prefix")).alias("prefix_chars"), F.when(moved, F.col("cut.upto") - F.col("cut.prefix")).alias("middle_chars"), output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of :func:`fill_in_middle` was made from."""
    part = F.split(F.col(output), "|".join(map(re.escape, MARKS)))
    second, third, last = (F.get(part, F.lit(i)) for i in (1, 2, 3))
    return F.when(F.col(form) == "psm", F.concat(second, last, third)).when(F.col(form) == "spm", F.concat(third, last, second)).otherwise(F.col(output))


def fim_digest(docs: DataFrame) -> DataFrame:
    """The rows of :func:`fill_in_middle` with hashes of the output and of the text restored from it."""
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))
