"""Mixing sources to target weights, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.llm.common import drop, materialize
from cohortframe.llm.decontaminate import words_of


def permuted(index: Column, n: Column, *seeds: Column, rounds: int = 12, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1 by swap-or-not rounds.

    In each round x is paired with (key - x) mod n, and a hash of the pair tells whether the two
    change places.  Every round is its own inverse, so it is a bijection for any n.
    """

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *seeds), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, other), -r, *seeds) % 2 == 0, other).otherwise(x)

    order = F.sequence(F.lit(rounds), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(rounds))
    return F.aggregate(order, index, step)


def measured(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, source, the words in the text (size), the text's hash (key), and ``carry``."""
    text = F.col("text")
    return docs.select("doc_id", "source", F.size(words_of(text, lower=False)).cast("long").alias("size"), F.xxhash64(text).alias("key"), *carry)


def _sum_before(rows: DataFrame, value: str, key: str, place: str, out: str, step: int = 4096) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over rows of the same ``key`` at smaller ``place`` (a whole number from 0).

    Sums go over runs of ``step`` places first, so one task holds a run of a key or one row per run, never all places of a hot key.
    """
    rows = rows.withColumn("_run", F.floor(F.col(place) / step))
    back = W.partitionBy(key).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    runs = rows.groupBy(key, "_run").agg(F.sum(value).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(back), F.lit(0)))
    runs = runs.select(F.col(key).alias("_key"), F.col("_run").alias("_at"), "_base")
    own = F.coalesce(F.sum(value).over(W.partitionBy(key, "_run").orderBy(place).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_own", own).join(runs, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_run") == F.col("_at")))
    return rows.withColumn(out, F.col("_own") + F.col("_base")).drop("_run", "_own", "_key", "_at", "_base")


def placed(rows: DataFrame, base: DataFrame, n_rows: int, group_rows: int = 256, broadcast_rows: int = 500_000) -> DataFrame:
    """``rows`` of :func:`measured` with each row's place in the sequence of its source's words.

    Adds salt and rn, which with source name a row, and start.  ``base`` is the measured table without
    texts.  A source's rows are dealt into salted groups of about ``group_rows`` rows; a window gives the place
    within a group and sums over groups give the group's own place, so a hot source is spread like any other.
    """
    salt = F.pmod(F.xxhash64("doc_id", "key"), F.lit(max(1, n_rows // group_rows)))
    w = W.partitionBy("source", "salt").orderBy("doc_id", "key")
    rows = rows.withColumn("salt", salt).withColumn("rn", F.row_number().over(w)).withColumn("before", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)))
    groups = _sum_before(base.withColumn("salt", salt).groupBy("source", "salt").agg(F.sum("size").alias("n")), "n", "source", "salt", "base")
    groups = materialize(groups.select(F.col("source").alias("_source"), F.col("salt").alias("_salt"), "base"), "groups")
    # a list of this many groups fits any executor; beyond it rows are shuffled once more
    groups = F.broadcast(groups) if groups.count() <= broadcast_rows else groups
    rows = rows.join(groups, F.col("source").eqNullSafe(F.col("_source")) & (F.col("salt") == F.col("_salt")))
    return rows.withColumn("start", F.coalesce("before", F.lit(0)) + F.col("base")).drop("before", "base", "_source", "_salt", "key")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, block: int = 64) -> DataFrame:
    """One row per source: its words, its target, its blocks and the slots it gets.

    Sources in code-point order, null last, take the weights in turn.  Targets share the total by
    weight but stop at ``most`` times the source's words; what is above goes to the others by
    weight until none is above.  In order of capacity per weight the stopped ones come
    first, so running sums find the share per weight without a loop.
    """
    by = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(by) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    up, everything = W.orderBy("level", "rank").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))
    share = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    s = s.withColumn("share", share)
    s = s.withColumn("per_weight", F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", "rank", "share"))).over(everything)["share"])
    s = s.withColumn("target", F.coalesce(F.least("cap", F.col("per_weight") * F.col("weight")), F.lit(0.0)))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    wanted = F.round(F.col("target") * F.col("blocks") / F.expr("nullif(source_size, 0)")).cast("long")
    s = s.withColumn("slots", F.coalesce(F.least(wanted, (F.lit(int(most)) * F.col("blocks")).cast("long")), F.lit(0)))
    s = s.withColumn("first", F.coalesce(F.sum("slots").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("all_slots", F.sum("slots").over(everything))
    return s.select("source", "rank", "source_size", "target", "blocks", "slots", "first", "all_slots")


def drawn_counts(plan: DataFrame, shard_slots: int = 1024, seed: int = 0, broadcast_rows: int = 500_000) -> DataFrame:
    """(shard, rank, n): multinomial counts of each source in each output shard of ``shard_slots`` slots.

    Every slot draws a number below the number of slots, by a hash; the source whose share of that range holds the number
    gets the slot.  Sources are looked up by equal cells of the range, and counts are summed up where they are drawn.
    """
    spark = plan.sparkSession
    r = plan.agg(F.max("all_slots").alias("n"), F.count("*").alias("k")).first()
    n, cells = r["n"] or 0, max(1024, 4 * r["k"])
    of = lambda x: F.floor(x * cells / F.lit(float(max(n, 1))))
    guide = plan.where("slots > 0").select("rank", "first", (F.col("first") + F.col("slots")).alias("end"))
    guide = guide.withColumn("cell", F.explode(F.sequence(of(F.col("first")), of(F.col("end") - 1))))
    guide = F.broadcast(guide) if cells + r["k"] <= broadcast_rows else guide.hint("merge")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(0, n, 1, tasks).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(-2)), F.lit(max(n, 1))).alias("t"))
    rows = rows.withColumn("cell", of(F.col("t"))).join(guide, "cell").where("first <= t and t < end")
    return rows.groupBy("shard", "rank").agg(F.count("*").alias("n"))


def slots(plan: DataFrame, shard_slots: int = 1024, seed: int = 0, ordered: bool = True) -> DataFrame:
    """(rank, block, epoch, shard, slot): the blocks of the mix in output order; ``slot`` is null unless ``ordered``.

    Shards draw their sources' counts (:func:`drawn_counts`), so a source's slots over all shards come near its quota.  To
    meet it exactly, what a source drew beyond its quota, chosen by a permutation, goes to the sources that fell short.  The
    k-th slot of a source reads block perm(k mod blocks) of its epoch k div blocks; a permutation orders each shard.
    """
    drawn = materialize(drawn_counts(plan, shard_slots, seed), "draws")
    totals = drawn.groupBy("rank").agg(F.sum("n").alias("got"))
    by = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    over, short = F.greatest(F.col("got") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("got"), F.lit(0))
    quota = plan.where("slots > 0").join(totals, "rank", "left").fillna(0, ["got"]).withColumn("over", over).withColumn("short", short)
    quota = quota.withColumn("over_at", F.coalesce(F.sum("over").over(by), F.lit(0))).withColumn("short_at", F.coalesce(F.sum("short").over(by), F.lit(0)))
    quota = materialize(quota.withColumn("moved", F.sum("over").over(W.partitionBy(F.lit(0)))), "quota")

    rows = _sum_before(drawn, "n", "rank", "shard", "k0")
    w = W.partitionBy("shard").orderBy("rank")
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("width", F.sum("n").over(W.partitionBy("shard")))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    place = F.col("shard") * shard_slots + permuted(F.col("at") + F.col("i"), F.col("width"), F.lit(seed), F.lit(-1), F.col("shard"))
    rows = rows.select("rank", "shard", (place if ordered else F.lit(None).cast("long")).alias("slot"), (F.col("k0") + F.col("i")).alias("k"))
    rows = rows.join(quota.select("rank", "got", F.col("slots").alias("own"), "over_at", "moved"), "rank")
    # where nothing is to move, the order of a source's slots may stay
    moved = permuted(F.col("k"), F.col("got"), F.lit(seed), F.lit(-3), F.col("rank"))
    rows = rows.withColumn("k", F.when(F.col("got") > F.col("own"), moved).otherwise(F.col("k")))
    # written once: below the joins that follow, the permutations would be reckoned again and again
    rows = materialize(rows, "placed")
    stay = rows.where("k < own").select("rank", "shard", "slot", "k")
    freed = rows.where("k >= own").select("shard", "slot", permuted(F.col("over_at") + F.col("k") - F.col("own"), F.col("moved"), F.lit(seed), F.lit(-4)).alias("f"))
    need = quota.where("short > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("short") - 1))).select("rank", (F.col("got") + F.col("i")).alias("k"), (F.col("short_at") + F.col("i")).alias("f"))
    every = stay.unionByName(freed.join(need.hint("merge"), "f").select("rank", "shard", "slot", "k"))
    every = every.join(plan.select("rank", "blocks"), "rank").withColumn("epoch", F.floor(F.col("k") / F.col("blocks")))
    every = every.withColumn("block", permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("rank"), F.col("epoch")))
    # a table of its own: a join above would push null checks of these columns below them, to be reckoned twice
    out = materialize(every.select("rank", "block", "epoch", "shard", "slot"), "slots")
    for t in (drawn, rows, quota):
        drop(t)
    return out


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """One row for each block that a row's words touch, with the words' places in the row: from (inclusive), to."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    out = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    return out.withColumn("from", F.greatest(F.col("block") * block - F.col("start"), F.lit(0))).withColumn("to", F.least((F.col("block") + 1) * block - F.col("start"), F.col("size")))


def mix_counts(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, block: int = 64, shard_slots: int = 1024, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    ``taken`` is how many of the row's words the mix takes, repeats counted: at most ``most`` (a whole
    number) times ``size``.  Blocks are ``block`` consecutive words of a source's rows laid end to end.
    Null or blank texts have size 0; a null source is a source of its own; repeated rows count each;
    reruns agree because order and draws depend on contents only.  Other columns are ignored; an empty table gives
    an empty one.
    """
    base = materialize(measured(docs), "measured")
    rows = placed(base, base, base.count())
    plan = materialize(targets(base, weights, most, block), "targets")
    times = slots(plan, shard_slots, seed, ordered=False).groupBy("rank", "block").agg(F.count("*").alias("times"))
    ranks = plan.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    pieces = _pieces(rows.join(ranks, F.col("source").eqNullSafe(F.col("_source"))), block)
    got = pieces.hint("merge").join(times, ["rank", "block"], "left")
    got = got.groupBy("rank", "salt", "rn", "doc_id", "size", "source_size", "target").agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken"))
    return got.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_texts(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, block: int = 64, shard_slots: int = 1024, seed: int = 0) -> DataFrame:
    """The mixed rows, in the columns of documents: one for each row and epoch that takes words of it.

    An epoch that takes all of a row's words gives its text as it is; else the words taken, in order,
    joined by a space.  ``n_chars`` is the new text's length.  Columns besides those of documents are left out; an empty
    table gives an empty one.
    """
    base = materialize(measured(docs), "measured")
    n = base.count()
    rows = placed(base, base, n)
    plan = materialize(targets(base, weights, most, block), "targets")
    ranks = plan.select(F.col("source").alias("_source"), "rank")
    pieces = _pieces(rows.join(ranks, F.col("source").eqNullSafe(F.col("_source"))), block).where("block is not null")
    got = pieces.hint("merge").join(slots(plan, shard_slots, seed, ordered=False), ["rank", "block"]).groupBy("source", "salt", "rn", "epoch")
    got = got.agg(F.sum(F.col("to") - F.col("from")).alias("n"), F.sort_array(F.collect_list(F.struct("from", "to"))).alias("taken"))
    got = got.select(F.col("source").alias("_source"), F.col("salt").alias("_salt"), F.col("rn").alias("_rn"), "n", "taken")
    whole = placed(measured(docs, "text", "lang"), base, n).join(got.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("salt") == F.col("_salt")) & (F.col("rn") == F.col("_rn")))
    # the words are bound to a lambda's variable, else each slice would split the text again
    words = F.array(words_of(F.col("text"), lower=False))
    part = F.transform(words, lambda w: F.array_join(F.flatten(F.transform("taken", lambda t: F.slice(w, (t["from"] + 1).cast("int"), (t["to"] - t["from"]).cast("int")))), " "))[0]
    whole = whole.withColumn("text", F.when(F.col("n") < F.col("size"), part).otherwise(F.col("text")))
    return whole.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_blocks(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, block: int = 64, shard_slots: int = 1024, seed: int = 0) -> DataFrame:
    """(shard, slot, source, words): the packed blocks of the mix in output order, each of ``block`` words (the last of a source may have fewer).

    A source's rows lie end to end, in the order of :func:`placed`, and are cut at multiples of ``block``.
    """
    base = materialize(measured(docs), "measured")
    plan = materialize(targets(base, weights, most, block), "targets")
    ranks = plan.select(F.col("source").alias("_source"), "rank")
    rows = placed(measured(docs, "text"), base, base.count()).where("size > 0")
    rows = rows.join(ranks, F.col("source").eqNullSafe(F.col("_source")))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)

    def piece(w: Column, b: Column) -> Column:
        low, high = F.greatest(b * block - F.col("start"), F.lit(0)), F.least((b + 1) * block - F.col("start"), F.col("size"))
        return F.struct(b.alias("block"), (F.col("start") + low).alias("at"), F.slice(w, (low + 1).cast("int"), (high - low).cast("int")).alias("w"))

    # the words are bound to a lambda's variable, else each piece would split the text again
    pieces = F.transform(F.array(words_of(F.col("text"), lower=False)), lambda w: F.transform(F.sequence(first, last), lambda b: piece(w, b)))[0]
    packed = rows.select("rank", "source", F.explode(pieces).alias("p")).groupBy("rank", "source", F.col("p.block").alias("block"))
    packed = packed.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p.at", "p.w"))), lambda x: x["w"])).alias("words"))
    return packed.hint("merge").join(slots(plan, shard_slots, seed), ["rank", "block"]).select("shard", "slot", "source", "words")
