import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.operators import nearest


def plain(ids, x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        order = sorted((d[i, j], ids[j]) for j in range(len(x)) if j != i)[:k]
        out += [(ids[i], j, r + 1) for r, (_, j) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("size,n", [(1024, 300), (40, 300), (7, 120), (40, 3)])
def test_equals_brute_force(spark, size, n):
    r = np.random.default_rng(n + size)
    base = r.normal(size=(6, 5)) * 10
    x = base[r.integers(6, size=n)] + r.normal(size=(n, 5))
    x[::9] = x[0]  # copies, more than a block of the smallest holds
    ids = r.permutation(n * 3)[:n].tolist()
    df = spark.createDataFrame([*zip(ids, x.tolist()), (10_000, None)], "obs_id int, vector array<double>").repartition(3)
    got = nearest.vector_neighbors(df, 10, size)
    rows = got.collect()
    assert sorted((t["src"], t["dst"], t["rank"]) for t in rows) == plain(ids, x, 10)
    at = dict(zip(ids, x))
    assert all(np.isclose(t["dist"], np.sqrt(((at[t["src"]] - at[t["dst"]]) ** 2).sum())) for t in rows)


def test_far_blocks_are_not_met(spark, monkeypatch):
    """Twenty far clusters: all but a few pairs of blocks are skipped, so each row has few candidates."""
    r = np.random.default_rng(1)
    x = (r.normal(size=(20, 3)) * 1000)[np.arange(2000) % 20] + r.normal(size=(2000, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "obs_id int, vector array<double>")
    made = {}
    keep = nearest.materialize
    monkeypatch.setattr(nearest, "materialize", lambda t, label, *a: made.setdefault(label, keep(t, label, *a)))
    got = nearest.vector_neighbors(df, 5, 50)
    assert got.count() == 10_000
    assert made["block-pairs"].count() < 40 * 39 / 3


def test_preservation_and_conservation(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(80, 4))
    a = spark.createDataFrame([(i, v.tolist(), "u" if i % 3 else None) for i, v in enumerate(x)], "obs_id int, vector array<double>, label string")
    assert nearest.neighbor_preservation(a, a, 7).first()[0] == 1.0
    y = x[:, :2]
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "obs_id int, vector array<double>")
    ids = list(range(80))
    sets = [{}, {}]
    for s, v in zip(sets, (x, y)):
        for i, j, _ in plain(ids, v, 7):
            s.setdefault(i, set()).add(j)
    want = np.mean([len(sets[0][i] & sets[1][i]) / len(sets[0][i] | sets[1][i]) for i in ids])
    assert np.isclose(nearest.neighbor_preservation(a, b, 7).first()[0], want)
    assert np.isclose(nearest.label_conservation(a, "label", 7).first()[0], np.mean([np.mean([(i % 3 == 0) == (j % 3 == 0) for j in sets[0][i]]) for i in ids]))
    assert nearest.neighbor_preservation(a.limit(2), b).first()[0] == 0.0
    assert nearest.vector_neighbors(a.limit(0)).count() == 0
    assert nearest.label_conservation(a.where(F.lit(False)), "label").first()[0] is None


def test_tiles_equal_brute_force(spark):
    """Blocks meet in pairs of tiles, singles and doubles, with ties by id; a row leaves a tile with no more than k candidates."""
    r = np.random.default_rng(5)
    x = r.integers(0, 4, size=(260, 3)).astype(float)
    x[::5] += 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "obs_id int, vector array<double>")
    got = nearest.vector_neighbors(df, 6, 20, tile_rows=60).collect()
    assert sorted((t["src"], t["dst"], t["rank"]) for t in got) == plain(list(range(260)), x, 6)
    for y in (x[:4], np.floor(x[:4])):
        assert (nearest._unpacked(nearest._packed(y), 4) == y).all()
    assert len(nearest._packed(x[:4])) > len(nearest._packed(np.floor(x[:4])))
    best = nearest._Best(x[:50], np.full(50, np.inf), 6)
    for at in range(50, 260, 70):
        best.meet(x[at : at + 70], np.arange(at, at + 70))
    assert (np.bincount(best.row) == 6).all()
