import hashlib

import numpy as np
import pytest

from cohortframe.llm import dualtree

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance string"


def plain(rows, k=40, rounds=5, width=64):
    """Lloyd rounds over all pairs."""
    kept = [(i, [int(np.floor(256 * np.float64(x))) for x in e]) for i, e, *_ in rows if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e)]
    if not kept:
        return []
    v = np.array([x for _, x in kept], np.int64)
    order = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"2:{'' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    c = v[order[:k]].copy()
    for _ in range(rounds):
        own = ((v[:, None] - c[None]) ** 2).sum(2).argmin(1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = v[own == j].sum(0) // (own == j).sum()
    d = ((v[:, None] - c[None]) ** 2).sum(2)
    own, far = d.argmin(1), d.min(1)
    return [(kept[j][0], int(own[j]), int(far[j]), int(far[own == own[j]].sum()), int(far.sum()), hashlib.sha256(",".join(map(str, c[own[j]].tolist())).encode()).hexdigest()) for j in range(len(kept))]


def rows(seed=0, n=900, width=64):
    r = np.random.default_rng(seed)
    base = r.normal(size=(25, width))
    out = [(i, (base[r.integers(25)] + r.normal(scale=0.1, size=width)).tolist(), 0, 0, "x") for i in range(n)]
    hot = out[5][1]
    out += [(n + i, hot, 0, 0, "x") for i in range(400)]
    n += 400
    out += [(n, None, 0, 0, "x"), (n + 1, [1.0] * 63, 0, 0, "x"), (n + 2, [float("nan")] + [1.0] * 63, 0, 0, "x"), (n + 3, [None] + [1.0] * 63, 0, 0, "x"), (n + 4, [float("inf")] + [0.0] * 63, 0, 0, "x"), (n + 5, [], 0, 0, "x")]
    return out + [(None, hot, 0, 0, "x"), (7, hot, 0, 0, "x"), (7, out[7][1], 0, 0, "x")]


def key(x):
    return tuple(-1 if y is None else y for y in x)


@pytest.mark.parametrize("block,leaf", [(8192, 32), (100, 4), (60, 1)])
def test_equals_brute_force(spark, block, leaf):
    data = rows()
    got = dualtree.cluster_vectors(spark.createDataFrame(data, SCHEMA).repartition(3), block_rows=block, leaf=leaf).collect()
    assert sorted(map(key, got)) == sorted(map(key, plain(data)))


def test_few_vectors_ties_and_empty(spark):
    few = [(i, [float(i % 3)] * 64, 0, 0, "x") for i in range(10)]
    got = dualtree.cluster_vectors(spark.createDataFrame(few, SCHEMA)).collect()
    assert sorted(map(key, got)) == sorted(map(key, plain(few)))
    assert dualtree.cluster_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_largest_coordinates(spark):
    wide = [(i, [1e300 * (-1) ** i] + [float(i * 1000)] * 63, 0, 0, "x") for i in range(60)]
    got = dualtree.cluster_vectors(spark.createDataFrame(wide, SCHEMA)).collect()
    held = [(i, [dualtree.LARGEST / 256 * (-1) ** i] + e[1:], 0, 0, "x") for i, e, *_ in wide]
    assert sorted(map(key, got)) == sorted(map(key, plain(held)))


@pytest.mark.parametrize("seed", range(5))
def test_cover_tree(seed):
    r = np.random.default_rng(seed)
    points = r.integers(-200, 200, (r.integers(1, 400), 4 if seed % 2 else 64))
    points[::7] = points[0]
    tree = dualtree.CoverTree.build(points, 5)
    assert sorted(tree.order.tolist()) == list(range(len(points))) and (tree.points == points[tree.order]).all()
    for (a, z, child, end), radius in zip(tree.nodes.tolist(), tree.radii, strict=True):
        far = np.sqrt(((tree.points[a:z] - tree.points[a]) ** 2).sum(1))
        assert far.max() <= radius + 1e-9
        if end:
            parts = tree.nodes[child:end]
            assert parts[0, 0] == a and parts[-1, 1] == z and (parts[1:, 0] == parts[:-1, 1]).all()


def test_pairs_are_skipped():
    """Well parted clusters: far fewer comparisons than vectors times centroids."""
    r = np.random.default_rng(3)
    base = r.integers(-4000, 4000, (40, 64))
    points = base[r.integers(40, size=4000)] + r.integers(-20, 20, (4000, 64))
    tree, rounds = dualtree.CoverTree.build(points, 32), dualtree.Rounds(base)
    sums, sizes = np.zeros((40, 64), np.int64), np.zeros(40, np.int64)
    rounds.totals(tree, sums, sizes)
    own = ((points[:, None] - base[None]) ** 2).sum(2).argmin(1)
    assert (sizes == np.bincount(own, minlength=40)).all()
    assert all((sums[c] == points[own == c].sum(0)).all() for c in range(40))
    assert rounds.compared < 4000 * 40 / 20 and rounds.skipped > 0
