"""Walk pairs, shifted information and its factorisation against numpy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import embedding, graph


@pytest.fixture(scope="module")
def paths(spark):
    """Walks that stay in one of four circles of nodes, mostly."""
    r = random.Random(9)
    rows = []
    for start in range(48):
        for walk in range(6):
            node, path = start, []
            for _ in range(r.randint(1, 9)):
                path.append(node)
                node = node // 12 * 12 + r.randrange(12) if r.random() < 0.9 else r.randrange(48)
            rows.append((start, walk, path))
    rows += [(100, 0, [100]), (101, 0, []), (102, 0, None), (103, 0, [1, None, 2, 2, 2])]
    return spark.createDataFrame(rows, "start long, walk int, path array<long>")


def counted(paths, window):
    n = Counter()
    for r in paths.collect():
        path = [x for x in r.path or [] if x is not None]
        for i, u in enumerate(path):
            for j, v in enumerate(path):
                n[u, v] += i != j and abs(i - j) <= window
    return +n


def dense(matrix):
    rows = matrix.collect()
    nodes = sorted({r.u for r in rows})
    m = np.zeros((len(nodes), len(nodes)))
    for r in rows:
        m[nodes.index(r.u), nodes.index(r.v)] = r.pmi
    return nodes, m


def test_pairs_and_information(paths):
    for window in (1, 3):
        n = counted(paths, window)
        pairs = embedding.window_pairs(paths, window)
        assert {(r.u, r.v): r.n for r in pairs.collect()} == n
        total, sums = sum(n.values()), Counter()
        for (u, _), c in n.items():
            sums[u] += c
        expected = {(u, v): math.log(c * total / sums[u] / sums[v] / 1.5) for (u, v), c in n.items()}
        found = {(r.u, r.v): r.pmi for r in embedding.shifted_pmi(pairs, 1.5).collect()}
        assert found.keys() == {k for k, x in expected.items() if x > 0}
        assert all(found[k] == pytest.approx(expected[k]) for k in found)


def test_spectrum_and_vectors_equal_numpy(paths):
    matrix = embedding.shifted_pmi(embedding.window_pairs(paths, 3))
    nodes, m = dense(matrix)
    u, s, _ = np.linalg.svd(m)
    # The subspace is as wide as the matrix: exact. Four circles: a gap behind the fourth value.
    whole = embedding.factorised(matrix, 6, spare=len(nodes))
    np.testing.assert_allclose(whole.values, s[:6], rtol=1e-9)
    few = embedding.factorised(matrix, 4, spare=12, rounds=40, tolerance=1e-13)
    np.testing.assert_allclose(few.values, s[:4], rtol=1e-6)
    for result, n in ((whole, 6), (few, 4)):
        rows = {r.node: r.vector for r in result.vectors.collect()}
        own = np.array([rows[x] for x in nodes])
        np.testing.assert_allclose((own**2).sum(axis=0), s[:n], rtol=1e-6)
        for k in range(n):
            if min(abs(s[k] - s[i]) for i in range(len(s)) if i != k) > 1e-3:
                assert abs(own[:, k] @ u[:, k]) == pytest.approx(math.sqrt(s[k]), rel=1e-4)
        assert ((own**3).sum(axis=0) > -1e-9).all()


def test_low_rank_and_empty(spark):
    v = np.array([1.0, 2.0, 0.5, 3.0])
    rows = [(i, j, float(v[i] * v[j])) for i in range(4) for j in range(4)]
    one = spark.createDataFrame(rows, "u long, v long, pmi double")
    found = embedding.factorised(one, 3)
    assert found.values == [pytest.approx(v @ v)]  # one direction, however many are asked for
    assert {r.node: r.vector for r in found.vectors.collect()} == {i: [pytest.approx(x)] for i, x in enumerate(v)}
    none = embedding.factorised(one.limit(0), 3)
    assert none.values == [] and none.vectors.count() == 0
    lonely = spark.createDataFrame([(1, 1, [1]), (2, 1, [2])], "start long, walk int, path array<long>")
    assert [r.vector for r in embedding.walk_vectors(lonely, 2, 3).vectors.collect()] == [[], []]


def test_triangles_are_merged_in_a_tree(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 5)) * [1, 10, 1e-3, 1, 5]
    tall = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "node long, x0 double, x1 double, x2 double, x3 double, x4 double")
    found = embedding.triangle(tall.repartition(23), 5, fan=3)
    np.testing.assert_allclose(found.T @ found, x.T @ x, rtol=1e-9, atol=1e-9)


def test_near_nodes_get_near_vectors(spark, paths):
    found = embedding.walk_vectors(paths.filter("start < 48"), 3, 4, rounds=6)
    rows = {r.node: np.array(r.vector) for r in found.vectors.collect()}
    assert rows.keys() == set(range(48))
    near, far = [], []
    for a in rows:
        for b in rows:
            if a < b and rows[a].any() and rows[b].any():
                c = rows[a] @ rows[b] / np.linalg.norm(rows[a]) / np.linalg.norm(rows[b])
                (near if a // 12 == b // 12 else far).append(c)
    assert np.mean(near) > 0.6 > 0.3 > np.mean(far)


def test_walks_feed_the_vectors(spark):
    edges = spark.createDataFrame([(a, b, 1) for a in range(6) for b in range(a + 1, 6)] + [(5, 6, 1)], "a long, b long, weight long")
    walks = graph.walks(edges, 4, 5)
    found = embedding.walk_vectors(walks, 2, 3)
    assert {r.node for r in found.vectors.collect()} == set(range(7)) and len(found.values) == 3
    again = embedding.walk_vectors(graph.walks(edges, 4, 5), 2, 3)
    np.testing.assert_allclose(again.values, found.values)
    assert embedding.walk_vectors(walks.limit(0), 2, 3).vectors.isEmpty()
    assert walks.select(F.size("path")).distinct().count() == 1
