import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from data import SCHEMA, table
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortframe.llm import decontaminate, mixing, simhash
from cohortframe.llm.components import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORDS.findall(low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (60, 61)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90, 60: 60, 61: 60}


@pytest.mark.parametrize("distance", [0, 1, 2, 4, 5])
def test_crowded_blocks_at_any_distance(spark, distance):
    r = np.random.default_rng(distance)
    base = [int(x) for x in r.integers(0, 1 << 62, 3)]
    fps = sorted({b ^ sum(1 << int(i) for i in r.choice(62, r.integers(0, 5), replace=False)) for b in base for _ in range(20)})
    root = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance])
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    blocks = distance + 2 if distance > 3 else None
    for crowded in (1024, 1) if distance < 5 else (1024,):
        got = dict(map(tuple, connected_components(simhash.links(df, distance, blocks, crowded)).collect()))
        assert [got.get(f, f) for f in fps] == [fps[c] for c in root]


def test_decontaminate_by_row_with_clashing_columns(spark):
    leak = " ".join(f"l{i}" for i in range(9))
    rows = [(1, "x " + leak, 0), (1, "clean text here it is", 0), (None, leak, 0), (None, "clean", 0), (2, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int").selectExpr("*", "1 as _key", "2 as _leak", "3 as words", "4 as h")
    items = spark.createDataFrame([(5, leak, 1)], "item_id long, text string, n int")
    got = decontaminate.decontaminate(docs, items)
    assert got.columns == docs.columns and sorted(((r.doc_id or 0), r.text or "") for r in got.collect()) == [(0, "clean"), (1, "clean text here it is"), (2, "")]


@pytest.mark.parametrize("crowded", [1024, 2])
def test_simhash(spark, crowded):
    df, rows = table(spark, 5, 80)
    fp = [plain_fingerprint(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    root = components(len(rows), links)
    big = 1 << 62
    ids = [big if r[0] is None else r[0] for r in rows]
    least = {}
    for i, c in zip(ids, root):
        least[c] = min(least.get(c, big), i)
    want = Counter((r[0], f"{f:016x}", None if least[c] == big else least[c]) for r, f, c in zip(rows, fp, root))
    got = simhash.simhash_dedup(df, crowded=crowded).select("doc_id", "fingerprint", "component_id")
    assert Counter(map(tuple, got.collect())) == want


def test_hubs_join_what_pairs_join(spark):
    r = np.random.default_rng(3)
    base = [int(x) for x in r.integers(0, 2**63, 4)]
    fps = {int(b) for b in base}
    for b in base:
        x = b
        for _ in range(40):
            for k in r.integers(0, 64, 2):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(signed, "fp long")
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    at = {s[0]: i for i, s in enumerate(signed)}
    for crowded in (1024, 3):
        edges = [(at[a], at[b]) for a, b in simhash.links(df, crowded=crowded).collect()]
        assert components(len(fps), edges) == want


def plain_containment(rows, items):
    def shingles(t):
        w = WORDS.findall((t or "").lower())
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())

    out = set()
    for i, t in items:
        s = shingles(t)
        for d, x, *_ in rows:
            n = len(s & shingles(x))
            if s and n >= 0.8 * len(s) - 1e-9:
                out.add((d, i, len(s), n))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination(spark, limit):
    df, rows = table(spark, 7, 40)
    r = np.random.default_rng(0)
    items = []
    for i, (_, t, *_) in enumerate(rows[:25]):
        w = WORDS.findall(t or "")
        a = int(r.integers(0, max(1, len(w) - 30)))
        part = w[a : a + int(r.integers(3, 40))]
        if len(part) > 8 and i % 3 == 0:
            part[int(r.integers(len(part)))] = "changed"
        items.append((i, " ".join(part).upper()))
    items += [(100, None), (101, " "), (102, items[0][1]), (0, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.containment(df, bench, broadcast_rows=limit)
    want = plain_containment(rows, items)
    assert sorted((tuple(x)[:4] for x in got.collect()), key=str) == want and want
    kept = decontaminate.decontaminate(df, bench, broadcast_rows=limit)
    bad = {w[0] for w in want}
    assert Counter(x[0] for x in kept.collect()) == Counter(x[0] for x in rows if x[0] not in bad)
    assert decontaminate.containment(spark.createDataFrame([], SCHEMA), bench).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    df, rows = table(spark, 9, 150)
    rows += [(5000 + i, "w " * 3000, "en", "zz", 1) for i in range(2)]
    df = df.unionByName(spark.createDataFrame(rows[-2:], SCHEMA))
    size = [len(WORDS.findall(r[1] or "")) for r in rows]
    sources = {}
    for r, n in zip(rows, size):
        sources[r[3]] = sources.get(r[3], 0) + n
    want = plain_targets(sources)
    got = mixing.mix_counts(df, block=16).collect()
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 4)) for r in got) == Counter((r[0], n, sources[r[3]], round(want[r[3]], 4)) for r, n in zip(rows, size))
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by[r.target, r.source_size] = by.get((r.target, r.source_size), 0) + r.taken
    assert all(abs(n - t) <= 32 for (t, _), n in by.items())
    assert sorted(map(str, mixing.mix_counts(df, block=16).collect())) == sorted(map(str, got))
    texts = mixing.mix_texts(df, block=16).collect()
    taken, there = Counter(), Counter()
    for r in texts:
        there[r.doc_id] += len(WORDS.findall(r.text))
    for r in got:
        taken[r.doc_id] += r.taken
    assert +there == +taken
    assert mixing.mix_counts(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.integers(1, 300))
def test_permutations(spark, n):
    from pyspark.sql import functions as F

    df = spark.range(n).withColumn("p", mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1)))
    rows = df.withColumn("q", mixing.permuted(F.col("p"), F.lit(n).cast("long"), F.lit(1), inverse=True)).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.q == r.id for r in rows)


def test_shard_counts_and_packed_blocks(spark):
    """Counts per shard add up and vary as draws do; quotas are met exactly; blocks hold the sources' words end to end."""
    import random

    r = random.Random(2)
    rows = [(i, " ".join(f"{'abc'[i % 3]}{i}_{j}" for j in range(r.randint(0, 90))), "en", "abc"[i % 3] if i % 7 else None, 1) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    base = mixing.measured(df)
    plan = mixing.targets(base, block=8)
    quota = {p["rank"]: p.slots for p in plan.collect()}
    n = sum(quota.values())
    counts = mixing.drawn_counts(plan, 32).collect()
    per_shard = Counter()
    for c in counts:
        per_shard[c.shard] += c.n
    assert all(v == 32 for k, v in per_shard.items() if k < n // 32) and sum(per_shard.values()) == n
    top = max(quota, key=quota.get)
    p, own = quota[top] / n, {c.shard: c.n for c in counts if c["rank"] == top}
    seen = np.array([own.get(k, 0) for k in range(n // 32)])
    assert abs(seen.mean() - 32 * p) < 4 * np.sqrt(32 * p * (1 - p) / len(seen)) and 0.5 < seen.var() / (32 * p * (1 - p)) < 1.7
    got = mixing.slots(plan, 32).collect()
    assert sorted(x.slot for x in got) == list(range(n)) and all(x.shard == x.slot // 32 for x in got)
    assert Counter(x["rank"] for x in got) == Counter({k: v for k, v in quota.items() if v})
    blocks = {p["rank"]: p.blocks for p in plan.collect()}
    for k in quota:
        times = Counter(x.block for x in got if x["rank"] == k)
        assert max(times.values()) - min(times[b] for b in range(blocks[k])) <= 1
    packed = mixing.mix_blocks(df, block=8, shard_slots=32).collect()
    assert sorted(x.slot for x in packed) == list(range(n))
    words = {s: {w for q in rows if q[3] == s for w in q[1].split()} for s in ("a", "b", "c", None)}
    size = {s: len(w) for s, w in words.items()}
    for x in packed:
        assert set(x.words) <= words[x.source] and (len(x.words) == 8 or len(x.words) == size[x.source] % 8)
    whole = {s: set() for s in words}
    for x in packed:
        whole[x.source] |= set(x.words)
    assert all(whole[s] == words[s] for k, s in enumerate(("a", "b", "c", None)) if quota[k] >= blocks[k])


def test_mixing_ignores_other_columns(spark):
    df, _ = table(spark, 3, 20)
    more = df.selectExpr("*", "1 as size", "2 as key", "3 as salt", "4 as rank", "5 as taken")
    assert sorted(map(str, mixing.mix_counts(more).collect())) == sorted(map(str, mixing.mix_counts(df).collect()))
    assert mixing.mix_texts(df.limit(0)).count() == 0 and mixing.mix_blocks(df.limit(0)).count() == 0


def test_fingerprints_ignore_other_columns(spark):
    df, _ = table(spark, 6, 30)
    more = df.selectExpr("*", "1 as fp", "2 as first", "3 as root", "4 as component_id")
    assert sorted(map(str, simhash.simhash_dedup(more).collect())) == sorted(map(str, simhash.simhash_dedup(df).collect()))
    assert simhash.simhash_dedup(df.limit(0)).count() == 0
