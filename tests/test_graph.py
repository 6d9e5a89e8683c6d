"""Two-sided search for bridges against plain breadth-first search."""

import random

import pytest

from touchline.operators import graph


def plain(edges, seeds, target, k):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    dist, level = {target: 0} if target in near else {}, [target]
    while level:
        new = sorted({n for x in level for n in near.get(x, ()) if n not in dist})
        dist |= {n: dist[level[0]] + 1 for n in new}
        level = new
    rows = set()
    for seed in set(seeds):
        if seed not in dist or dist[seed] > k:
            continue
        paths = {seed: 1}
        for hop in range(dist[seed] + 1):
            rows |= {(seed, dist[seed], hop, n, c) for n, c in paths.items()}
            onwards = {}
            for n, c in paths.items():
                for x in near[n]:
                    if dist[x] == dist[seed] - hop - 1:
                        onwards[x] = onwards.get(x, 0) + c
            paths = onwards
    return rows


def frame(spark, edges):
    return spark.createDataFrame([(a, b, 1) for a, b in edges], "a long, b long, weight long")


@pytest.mark.parametrize("k", [1, 4, 5])
def test_bridges_by_brute_force(spark, k):
    r = random.Random(k)
    edges = {(a, b) for a, b in ((r.randrange(90), r.randrange(90)) for _ in range(130))}
    edges |= {(200, 201), (201, 202), (5, 5)}  # out of reach; a node beside itself
    seeds, target = [0, 1, 2, 3, 17, 17, 33, 200, 999], 33
    found = graph.bridges(frame(spark, edges), seeds, target, k)
    rows = [tuple(x) for x in found.select("seed", "distance", "hop", "node", "n_paths").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain(edges, seeds, target, k)


def test_long_paths_and_many_equal_ones(spark):
    line = [(i, i + 1) for i in range(12)]
    diamonds = [(100 + 3 * i, 100 + 3 * i + j) for i in range(4) for j in (1, 2)]
    diamonds += [(100 + 3 * i + j, 103 + 3 * i) for i in range(4) for j in (1, 2)]
    for edges, seeds, target, k in ((line, [0, 3, 12], 12, 12), (line, [0], 12, 11), (diamonds, [100, 103], 112, 8)):
        rows = {tuple(x) for x in graph.bridges(frame(spark, edges), seeds, target, k).collect()}
        assert rows == plain(edges, seeds, target, k)
    assert max(x[-1] for x in rows) == 16


def test_nothing_to_find(spark):
    df = frame(spark, [(1, 2), (3, 4)])
    assert graph.bridges(df, [1], 4, 6).isEmpty()
    assert graph.bridges(df, [77], 4, 6).isEmpty() and graph.bridges(df, [1], 77, 6).isEmpty()
    assert graph.bridges(df.limit(0), [1], 2, 3).isEmpty()
    assert [tuple(x) for x in graph.bridges(df, [4], 4, 3).collect()] == [(4, 0, 0, 4, 1)]


def test_the_edges_stay_where_they_are(spark, limits):
    edges = graph.bucketed(frame(spark, [(i, i + 1) for i in range(500)]).selectExpr("a AS src", "b AS dst"))
    frontier = spark.range(200).selectExpr("id AS src", "id AS seed")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = edges.join(frontier, "src")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange") == 1  # the frontier's


def test_shared_items_counted_alike_hot_or_not(spark, limits):
    r = random.Random(5)
    rows = [(r.randrange(40), r.randrange(60)) for _ in range(700)] + [(99, m) for m in range(80)] + [(None, 1), (None, 2), (3, None)]
    df = spark.createDataFrame(rows * 2, "item long, member long")
    shared = {}
    for item in {i for i, _ in rows if i is not None}:
        members = sorted({m for i, m in rows if i == item and m is not None})
        for k, a in enumerate(members):
            for b in members[k + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    assert {(x["a"], x["b"]): x["weight"] for x in graph.co_edges(df).collect()} == shared
    limits(PAIR_ROWS=30)
    assert {(x["a"], x["b"]): x["weight"] for x in graph.co_edges(df).collect()} == shared


def test_members_are_not_joined_with_themselves(spark):
    plan = graph.co_edges(spark.createDataFrame([(1, 1), (1, 2)], "item long, member long"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # nor sorted for it


def test_walkers_move_and_not_the_edges(spark):
    edges = frame(spark, [(i, (i * 7 + 1) % 300) for i in range(300)] + [(i, i + 1) for i in range(299)])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph.walks(edges, 2, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 3  # the walkers', once a step
