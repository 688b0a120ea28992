import numpy as np

from cohortframe.llm import epsilon

SCHEMA = "vec_id long, embedding array<float>, label int, id long"


def vectors(seed=0):
    r = np.random.default_rng(seed)
    rows, n = [], 0
    for label in (0, 1, None):
        base = r.normal(size=(12, 8))
        for _ in range(90):
            x = base[r.integers(12)] + r.normal(scale=0.18, size=8)
            rows.append((n, x.astype(np.float32).tolist(), label, 0))
            n += 1
    hot = rows[3][1]
    rows += [(n + i, hot, 0, 0) for i in range(60)]
    n += 60
    rows += [(n, None, 0, 0), (n + 1, [0.0] * 8, 0, 0), (n + 2, [float("nan")] + [1.0] * 7, 0, 0), (n + 3, [None] + [1.0] * 7, 0, 0), (n + 4, [], 0, 0), (n + 5, [1.0, 2.0], 0, 0), (n + 6, hot[:], 1, 0), (n + 7, [float("inf")] + [1.0] * 7, 1, 0), (None, hot, 0, 0)]
    return rows


def plain(rows, least):
    big = 1 << 62
    ids = [big if r[0] is None else r[0] for r in rows]
    ok = [r[2] is not None and bool(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], np.float64) / np.linalg.norm(np.array(r[1], np.float64)) if o else None for r, o in zip(rows, ok)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                if ids[a] < ids[b]:
                    root[b] = a
                else:
                    root[a] = b
    return sorted((ids[i], n[i], ids[find(i)], find(i) == i) for i in range(len(rows)))


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(epsilon, "_LEAF", 16)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    big = 1 << 62
    for size in (4096, 40):
        got = epsilon.embedding_links(df, 0.93, size).collect()
        assert sorted((big if r.vec_id is None else r.vec_id, r.n_links, big if r.component_id is None else r.component_id, r.kept) for r in got) == plain(rows, 0.93)


def test_empty(spark):
    assert epsilon.embedding_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_in_reach_are_met_once(spark):
    r = np.random.default_rng(4)
    rows = []
    for k in range(120):
        lo = r.uniform(-1, 0.9, 4)
        rows.append((str(k % 2), k, lo.tolist(), np.minimum(1, lo + r.uniform(0, 0.5, 4)).tolist()))
    rows += [("short", 200 + k, [v], [v]) for k, v in enumerate((-0.3, 0.0, 0.2))]
    df = spark.createDataFrame(rows, "`group` string, block long, lo array<double>, hi array<double>")
    for reach in (0.05, 0.374):
        want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] <= b[1] and sum(max(0, y - v, x - w) ** 2 for x, v, y, w in zip(a[2], a[3], b[2], b[3])) <= reach * reach + 1e-9)
        assert sorted(map(tuple, epsilon.near_blocks(df, reach).collect())) == want


def test_a_hot_label_sends_a_block_to_tiles_not_to_pairs(spark):
    sent = []
    for n in (32, 64):
        pairs = spark.range(n * n).selectExpr(f"id div {n} AS block1", f"id % {n} AS block2")  # all pairs: vectors that nothing tells apart
        t = epsilon.tiles(pairs.where("block1 <= block2"), 8)
        per_block = {r["block"]: r["count"] for r in t.groupBy("block").count().collect()}
        assert len(per_block) == n and max(per_block.values()) <= n // 8
        sent.append(sum(per_block.values()))
        assert t.selectExpr("size(pairs) AS n").agg({"n": "max"}).first()[0] <= 64
    assert sent == [32 * 4, 64 * 8]


def test_blocks_by_bytes_and_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(epsilon, "_LEAF", 4)
    monkeypatch.setattr(epsilon, "TILE", 2)
    rows = vectors(1)
    big = 1 << 62
    got = epsilon.embedding_links(spark.createDataFrame(rows, SCHEMA), 0.93, 4096, 640).collect()
    assert sorted((big if r.vec_id is None else r.vec_id, r.n_links, big if r.component_id is None else r.component_id, r.kept) for r in got) == plain(rows, 0.93)
