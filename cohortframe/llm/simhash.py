"""Near-duplicate detection by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import materialize
from cohortframe.llm.components import connected_components
from cohortframe.plans.ship import ship

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSET = np.arange(8) * 256
_digest = partial(xxhash.xxh64_intdigest, seed=42)


def majority(h: np.ndarray) -> int:
    """The number whose bits are set in over half of the 64-bit hashes; zero for none."""
    if not len(h):
        return 0
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _OFFSET).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * seen[::-1] > len(h)).tobytes(), "big")


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text: ASCII lower case, word shingles with repeats, XXH64 seed 42.

    A bit is set if it is set in over half of the shingle hashes.  Fewer words than
    a shingle: the whole sequence is one shingle.  No words, or null: zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    n = len(words) - k + 1
    return majority(np.fromiter(map(_digest, map(b" ".join, zip(*(words[i : i + n] for i in range(k)), strict=True))), np.uint64, n))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): the fingerprint of each text as a signed 64-bit number."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t.as_py(), shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - distance`` of the blocks of 64 bits.

    Two fingerprints that differ in at most ``distance`` bits leave that many
    blocks untouched, so they agree under at least one mask.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    single = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    return [sum(c) for c in combinations(single, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hub_edges(members: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Links within crowded blocks without comparing pairs.

    If x is within half the distance of a and within the rest of it of b, then a and b differ in at most ``distance`` bits; and
    every pair within the distance has such an x between them.  So each member is listed under its neighbours x, and all
    of a group with a member at half the distance or less link to that member: rows grow with the members.
    """
    free = [[i for i in range(64) if not m >> i & 1] for m in masks]
    half = distance // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which = b.column(0).to_numpy(zero_copy_only=False)
            fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for c in np.unique(which):
                picks = [p for k in range(distance - half + 1) for p in combinations(free[c], k)]
                flips = np.array([sum(1 << i for i in p) for p in picks], np.uint64)
                near = np.array([len(p) <= half for p in picks])
                for x in fp[which == c]:
                    n = len(flips)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array((x ^ flips).view(np.int64)), pa.array(near), pa.array(np.full(n, x).view(np.int64))], ["c", "hub", "near", "fp"])

    rows = members.select("c", "fp").mapInArrow(run, "c int, hub long, near boolean, fp long")
    # the hub keeps the masked bits, so (c, hub) also tells the block
    to = rows.groupBy("c", "hub").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("to"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    to = to.where("`to` is not null and lo < hi").select("c", "hub", "to")
    return rows.join(to, ["c", "hub"]).where("fp != `to`").select(F.col("fp").alias("a"), F.col("to").alias("b"))


def links(fps: DataFrame, distance: int = 3, blocks: int | None = None, crowded: int = 1024) -> DataFrame:
    """Links (a, b) that join the same components as all pairs within ``distance`` bits.

    ``fps`` has one row per distinct fingerprint.  Each row goes under every
    choice of ``blocks - distance`` blocks (``blocks``: twice the distance if not given); rows that share a choice are
    candidates and the Hamming distance decides inside the join.  A block of more than
    ``crowded`` members is linked by :func:`_hub_edges` instead.
    """
    masks = block_masks(distance, blocks or max(2 * distance, 1))
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])).alias("c", "k"))
    sizes = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes.hint("merge"), ["c", "k"])
    usual = keyed.where(F.col("n") <= crowded)
    x, y = usual.select("c", "k", F.col("fp").alias("a")), usual.select("c", "k", F.col("fp").alias("b"))
    out = x.join(y, ["c", "k"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    return out.unionByName(_hub_edges(keyed.where(F.col("n") > crowded), masks, distance)).distinct()


def simhash_dedup(docs: DataFrame, distance: int = 3, shingle: int = 3, blocks: int | None = None, crowded: int = 1024) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for every row of ``docs``.

    ``fingerprint`` is 16 hexadecimal digits; ``component_id`` is the smallest doc_id that
    links of at most ``distance`` bits reach; ``kept`` marks the document of that id.
    Texts that are null or have no words have fingerprint zero and link like any other.
    Documents of one fingerprint are one node, so groups of exact copies cost one row.
    Repeated rows stay repeated; other columns are ignored; an empty table gives an empty one.
    """
    fps = materialize(fingerprints(docs, shingle), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = connected_components(links(nodes.select("fp"), distance, blocks, crowded))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(roots, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
