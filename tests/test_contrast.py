from math import erf

import numpy as np
import pytest

from cohortframe.operators import contrast as C

STILL = dict(dropout=0.0, feature_dropout=0.0, edge_dropout=0.0, mask=0.0, noise=0.0)


def ring(n=18, features=4, seed=0):
    r = np.random.default_rng(seed)
    nodes = [(f"s{i % 3}", i, "a" if i % 3 else "b", r.normal(size=features).tolist()) for i in range(n)]
    edges = []
    for i in range(n):
        for d in (3, -3):
            edges.append((f"s{i % 3}", i, (i + d) % n, 0.5))
    return nodes, edges


def batch(nodes, edges):
    x = np.array([r[3] for r in nodes])
    x = (x - x.mean(0)) / x.std(0)
    order = sorted(range(len(nodes)), key=lambda i: nodes[i][:2])
    at = {nodes[i][1]: k for k, i in enumerate(order)}
    near = C.Adjacency(np.array([at[e[1]] for e in edges]), np.array([at[e[2]] for e in edges]), np.array([e[3] for e in edges]), len(nodes))
    return C.Batch(0, x[order], near, np.arange(len(nodes)), np.array([nodes[i][0] for i in order]), np.array([nodes[i][2] for i in order]))


def plain(flat, b, s):
    """The loss in dense matrices and loops over nodes."""
    w1, b1, w2, b2, w3, b3, s1, t1, s2, t2 = C._split(flat, b.x.shape[1], s)
    n = len(b.x)
    a = np.zeros((n, n))
    for i, j, w in zip(*b.near.parts):
        a[i, j] += w
    act = np.vectorize(lambda v: v * 0.5 * (1 + erf(v / 2**0.5)))

    def norm(x, scale, shift):
        return (x - x.mean(1)[:, None]) / np.sqrt(x.var(1)[:, None] + 1e-5) * scale + shift

    g = act(b.x @ w1 + b1)
    g = norm(g + a @ g, s1, t1)
    g = act(g @ w2 + b2)
    g = norm(g + a @ g, s2, t2)
    z = g @ w3 + b3
    z = z / np.linalg.norm(z, axis=1)[:, None]
    like = z @ z.T / s.temperature
    nce = np.mean([np.log(np.exp(like[i]).sum()) - like[i, i] for i in range(n)])
    m = a @ z
    near = 1 - np.mean([z[i] @ m[i] / np.linalg.norm(m[i]) for i in range(n)])
    centers = {k: z[b.samples == k].mean(0) for k in sorted(set(b.samples))}
    cond = {k: b.conditions[b.samples == k][0] for k in centers}
    goal = {c: np.mean([centers[k] for k in centers if cond[k] == c], 0) for c in set(cond.values())}
    balance = np.mean([((centers[k] - goal[cond[k]]) ** 2).sum() for k in centers])
    by = [z[b.conditions == c].mean(0) for c in sorted(set(b.conditions))]
    wide = np.linalg.norm(by[0] - by[1])
    return np.array([nce + s.neighbor_weight * near + s.balance_weight * balance - s.spread_weight * wide, nce, near, balance, wide])


def test_loss_equals_plain_version():
    s = C.Settings(hidden=7, width=5, **STILL)
    b = batch(*ring())
    flat = C.first_parameters(4, s)
    assert np.allclose(C.batch_loss(flat, b, s, 1)[0], plain(flat, b, s), atol=1e-9)


@pytest.mark.parametrize("still", [True, False])
def test_gradient_equals_differences(still):
    s = C.Settings(hidden=6, width=4, **(STILL if still else {}))
    b = batch(*ring())
    b.seeds, b.samples, b.conditions = b.seeds[:11], b.samples[:11], b.conditions[:11]
    flat = C.first_parameters(4, s)
    _, g = C.batch_loss(flat, b, s, 3)
    for i in range(0, len(flat), 5):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        number = (C.batch_loss(flat + step, b, s, 3)[0][0] - C.batch_loss(flat - step, b, s, 3)[0][0]) / 2e-5
        assert abs(number - g[i]) < 1e-6


NODES, EDGES = "sample_id string, obs_id long, condition string, features array<double>", "sample_id string, src long, dst long, weight double"


def test_one_batch_on_spark_equals_plain_version(spark):
    nodes, edges = ring()
    s = C.Settings(hidden=7, width=5, **STILL)
    flat = C.first_parameters(4, s)
    table = C.neighborhoods(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    parts, g = C.total_loss(table, flat, s, 1)
    b = batch(nodes, edges)
    assert np.allclose(parts, plain(flat, b, s), atol=1e-9)
    assert np.allclose(g, C.batch_loss(flat, b, s, 1)[1], atol=1e-9)


def test_batches_give_the_whole_graphs_embedding_and_the_loss_falls(spark):
    nodes, edges = ring(60)
    df, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    s = C.Settings(hidden=8, width=4, rounds=6)
    table = C.neighborhoods(df, e, batch_nodes=20)
    assert table.count() > 1
    flat, history = C.fit(table, s)
    assert history[-1]["total_loss"] < history[0]["total_loss"]
    b = batch(nodes, edges)
    z, _ = C.encode(b.x, b.near, C._split(flat, 4, s))
    order = sorted(nodes, key=lambda r: r[:2])
    got = {r.obs_id: r.embedding for r in C.embed(table, flat, s).collect()}
    assert len(got) == 60
    for k, r in enumerate(order):
        assert np.allclose(got[r[1]], z[k], atol=1e-9)


def test_nulls_repeats_lone_nodes_and_empty_tables(spark):
    nodes, edges = ring(9)
    nodes += [nodes[0], (None, 90, "a", [0.0] * 4), ("s0", 91, None, [float("nan"), None, 1.0, 2.0]), ("s0", 92, "a", None)]
    edges += [("s0", 0, 999, 0.5)]
    s = C.Settings(hidden=4, width=3, rounds=1)
    out, _ = C.graph_embedding(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), s)
    assert sorted(r.obs_id for r in out.collect()) == [*range(9), 91]
    out, history = C.graph_embedding(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), s)
    assert out.count() == 0 and history == []


def test_packed_batches_are_those_read_and_give_the_same_loss(spark):
    nodes, edges = ring(60)
    n = spark.createDataFrame(nodes, "sample_id string, obs_id long, condition string, features array<double>")
    e = spark.createDataFrame(edges, "sample_id string, src long, dst long, weight double")
    s = C.Settings(hidden=8, width=4, rounds=2)
    batches = C.neighborhoods(n, e, 20)
    packed, own = C.packed(batches), {r["batch"]: C._read(r.asDict(True))[0] for r in batches.collect()}
    assert packed.count() == len(own) == 3
    for r in packed.collect():
        got, want = C._unpacked(r.asDict()), own[r["batch"]]
        assert (got.x == want.x).all() and (got.seeds == want.seeds).all() and got.name == want.name
        assert all((a == b).all() for a, b in zip(got.near.parts, want.near.parts, strict=True))
    flat = C.first_parameters(4, s)
    for a, b in zip(C.total_loss(packed, flat, s, 1), C.total_loss(batches, flat, s, 1), strict=True):
        assert np.allclose(a, b, rtol=1e-12, atol=1e-14)


def test_neighbours_sums_with_and_without_a_hub():
    r = np.random.default_rng(3)
    for hub in (2, 50):
        src, dst, w = np.concatenate((np.zeros(hub, int), r.integers(0, 9, 20))), r.integers(0, 60, hub + 20), r.random(hub + 20)
        near, x, dense = C.Adjacency(src, dst, w, 60), r.normal(size=(60, 5)), np.zeros((60, 60))
        np.add.at(dense, (src, dst), w)
        assert np.allclose(near.times(x), dense @ x) and np.allclose(near.times(x, True), dense.T @ x)
