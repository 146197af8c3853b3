import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rayscape.llm import embeddup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, keys string, row string, id string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, None, "a", "b", "c", "d") for i, v in zip(ids, vectors)], SCHEMA).repartition(3)


def vectors(seed=0, n=300, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x[50:120] = x[3] + 0.05 * rng.standard_normal((70, dims))
    x[120:130] = x[4]
    x[130] = 7 * x[5]
    out = [[float(np.float32(c)) for c in r] for r in x]
    nan, none, inf = list(out[0]), list(out[1]), list(out[2])
    nan[3], none[0], inf[1] = math.nan, None, math.inf
    return [*out, None, [0.0] * dims, nan, none, inf, []]


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "BLOCK", 32)  # many blocks in a bucket
    vs = vectors()
    good = [i for i, v in enumerate(vs) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    x = np.array([vs[i] for i in good])
    near = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.95
    name = {i: i for i in range(len(vs))}
    for _ in range(20):
        for a, i in enumerate(good):
            name[i] = min(name[good[b]] for b in np.flatnonzero(near[a]))
    rows = {r.vec_id: r for r in embeddup.link(table(spark, vs)).collect()}
    links = {i: int(near[a].sum()) - 1 for a, i in enumerate(good)}
    for i in range(len(vs)):
        assert (rows[i].n_links, rows[i].component_id, rows[i].kept) == (links.get(i, 0), name[i], name[i] == i)


def test_codes_estimate_without_bias():
    rng = np.random.default_rng(1)
    u = rng.standard_normal((200, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    turned, signs, factor = embeddup.codes(u, embeddup.rotation(256, 64, 5))
    error = (signs @ turned.T) / 16 / factor[:, None] - u @ u.T
    assert abs(error[~np.eye(200, dtype=bool)].mean()) < 0.005
    assert embeddup.may_link(signs, factor, turned, 0.95)[u @ u.T >= 0.95].all()


def test_bounds_hold_for_rough_vectors():
    """What eight bits a component lose is within the error that widens the bound."""
    rng = np.random.default_rng(2)
    u = rng.standard_normal((300, 48))
    u[150:] = u[:150] + 0.2 * rng.standard_normal((150, 48))
    u /= np.linalg.norm(u, axis=1)[:, None]
    _, signs, factor = embeddup.codes(u, turn := embeddup.rotation(256, 48, 5))
    low, step, error = embeddup.eight_bits(u)
    rough = low * step[:, None]
    assert (np.linalg.norm(rough - u, axis=1) <= error + 1e-12).all() and error.max() < 0.02
    assert embeddup.may_link(signs, factor, rough @ turn.T, 0.95, error)[u @ u.T >= 0.95].all()


def test_links_of_any_size_and_magnitude(spark):
    """Vectors meet those of their own size only, and lengths whose squares leave the range of doubles do no harm."""
    vs = [[3.0, 4.0], [3e-30, 4e-30], [3e37, 4e37], [3.0, 4.0, 0.0], [6.0, 8.0, 0.1], [1.0], [-1.0], [2.0]]
    rows = {r.vec_id: (r.n_links, r.component_id) for r in embeddup.link(table(spark, vs)).collect()}
    assert rows == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (0, 6), 7: (1, 5)}


def test_links_edge_cases(spark):
    assert embeddup.link(table(spark, [])).count() == 0
    rows = embeddup.link(table(spark, [[1.0, 0.0], [2.0, 0.0], [1.0, 0.0], [0.0, 1.0]], [None, 5, 5, 9])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in rows) == [(0, 2, 0, True), (5, 2, 5, True), (5, 2, 5, True), (9, 0, 9, True)]


@pytest.mark.parametrize("page", [16, 4096])
def test_topk_equals_brute_force(spark, monkeypatch, page):
    monkeypatch.setattr(topk, "PAGE", page)
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    vs = vectors(2)
    good = [i for i, v in enumerate(vs) if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(np.array([vs[i] for i in good]) * 256)
    want = []
    for a, i in enumerate(good):
        if i % 50 == 0:
            s = [(-int(x[a] @ x[b]), j) for b, j in enumerate(good) if b != a]
            want += [(i, k, j, -t) for k, (t, j) in enumerate(sorted(s)[:5], 1)]
    rows = topk.search(table(spark, vs), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows) == want


def test_topk_edge_cases(spark):
    q = F.col("vec_id") % 50 == 0
    assert topk.search(table(spark, []), q).count() == 0
    assert topk.search(table(spark, [[1.0, 2.0]]), q).count() == 0
    few = topk.search(table(spark, [[1.0], [1.0], [1.0], None], [0, 2, None, 3]), q).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(0, 1, 2, 65536)]
    same = topk.search(table(spark, [[1.0, 0.0]] * 600), q).filter("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in same] == [1, 2, 3, 4, 5]


def test_topk_sizes_and_large_components(spark):
    """Vectors meet those of their own size only; components of any magnitude are scored in whole numbers, up to a long."""
    rng = random.Random(3)
    vs = [[rng.uniform(-1, 1) for _ in range(3 + i % 2)] for i in range(220)]
    vs[50], vs[61], vs[100], vs[7] = [1e30, -2e30, 5.0], [3e4, 7e7, 0.5, 1e5], [1e6, 1e5, 3e4], [-1e30, 0.0, 0.0, 1.0]
    vs = [[float(np.float32(c)) for c in v] for v in vs]
    x = [[math.floor(Fraction(c) * 256) for c in v] for v in vs]
    want = []
    for i in range(0, 220, 50):
        s = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x[i], x[j])))), j) for j in range(220) if j != i and len(x[i]) == len(x[j])]
        want += [(i, k, j, -t) for k, (t, j) in enumerate(sorted(s)[:5], 1)]
    rows = topk.search(table(spark, vs), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows) == want


def test_tree_prunes_clustered_vectors():
    """Where vectors have a place, most are never scored."""
    rng = np.random.default_rng(6)
    x = np.floor(256 * (rng.standard_normal((40, 8))[rng.integers(0, 40, 4000)] + 0.05 * rng.standard_normal((4000, 8))))
    tree = topk.Tree(x, np.arange(4000), np.arange(4000), float((x**2).sum(axis=1).max()))
    for i in range(50):
        s, found = tree.search(x[i], 5, -math.inf, i)
        best = sorted(zip((-(x @ x[i])).tolist(), range(4000)))
        assert list(zip((-s).tolist(), found.tolist())) == [b for b in best if b[1] != i][:5]
    assert tree.scored < 0.25 * 50 * 4000
