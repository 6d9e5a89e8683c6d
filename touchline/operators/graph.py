"""Co-occurrence graph: edges, bridges, node embedding."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.draws import drawn
from touchline.operators.skew import checked_broadcast, hot_groups, number_within, pairs_within
from touchline.session import PAIR_ROWS, cut_lineage, setting, shared_dir


def co_edges(membership: DataFrame) -> DataFrame:
    """Edges a < b with the number of items both members share (item, member).

    The members of an item meet in one sorted array, which costs one shuffle of the
    memberships and no sort of them. Items with more rows than `pairGroupRows` are
    joined in parts instead.
    """
    rows = membership.select("item", "member").filter("item IS NOT NULL AND member IS NOT NULL")
    hot = hot_groups(rows, ["item"], setting(rows.sparkSession, PAIR_ROWS))
    few = rows if hot is None else rows.join(hot, "item", "left_anti")
    members = few.groupBy("item").agg(F.sort_array(F.collect_set("member")).alias("_m")).filter(F.size("_m") > 1)
    first = members.select("_m", F.posexplode("_m").alias("_i", "a"))
    pairs = first.select("a", F.explode(F.slice("_m", F.col("_i") + 2, F.size("_m"))).alias("b"))
    if hot is not None:
        many = rows.join(hot.drop("_rows"), "item", "left_semi").distinct()
        split = pairs_within(many, ["item"], "member")
        pairs = pairs.unionByName(split.select(F.col("member_a").alias("a"), F.col("member_b").alias("b")))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight"))


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
    )
    return edges.select(F.inline(ends))


def bucketed(rows: DataFrame, keys: Sequence[str] = ("src",)) -> DataFrame:
    """The rows as a table in the shared folder, bucketed and sorted by `keys`:
    a search that joins on them moves its frontier and not the rows."""
    spark = rows.sparkSession
    name = f"touchline_edges_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(buckets, *keys)  # one file per bucket
    writer = rows.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    writer.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def bridges(edges: DataFrame, seeds: Sequence[int], target: int, k: int) -> DataFrame:
    """Nodes on the shortest paths of at most k hops from each seed to the target.

    The search goes from both ends to the middle, so neither side has to reach far:
    from the target level by level, and from the seeds with the number of shortest
    paths. The nodes where both meet are on the shortest paths; from them the paths
    are followed back to the seeds and on to the target. Rows are (seed, distance,
    hop, node, n_paths), n_paths counting the shortest paths from the seed to the
    node, so many equal paths stay one row per node.

    Edges stay where they are, in a table bucketed by node; a step joins a frontier to
    it, and every level is stored. A seed that is the target has distance 0; seeds and
    targets outside the graph, and seeds out of reach, have no rows.
    """
    adjacent = bucketed(_both_ways(edges).filter("src <> dst").distinct())
    near, far = k // 2, k - k // 2
    back = _levels_back(adjacent, target, far)
    ahead = _levels_ahead(adjacent, seeds, near)
    met = ahead.join(checked_broadcast(back), "node")
    # Shortest distance, and the one level at which each of the shortest paths is cut.
    total = met.groupBy("seed").agg(F.min(F.col("hop") + F.col("dist")).alias("distance"))
    cut = cut_lineage(
        met.join(F.broadcast(total), "seed")
        .filter((F.col("hop") + F.col("dist") == F.col("distance")) & (F.col("hop") == F.least(F.lit(near), "distance")))
        .select("seed", "distance", "hop", "node", "n_paths")
    )
    found = cut
    for hop in range(near - 1, -1, -1):
        # Backwards: nodes of the level before that lead to one that is kept.
        before = ahead.filter(F.col("hop") == hop)
        later = found.filter(F.col("hop") == hop + 1).select("seed", "distance", F.col("node").alias("src"))
        leading = adjacent.join(checked_broadcast(later), "src").select("seed", "distance", F.col("dst").alias("node")).distinct()
        found = found.unionByName(cut_lineage(before.join(leading, ["seed", "node"]).select(*cut.columns)))
    at = cut
    for hop in range(1, k + 1):
        # Onwards: each step is one nearer to the target. Levels of a seed end with its distance.
        step = at.filter(F.col("hop") == hop - 1).select("seed", "distance", F.col("node").alias("src"), "n_paths")
        near_target = back.select(F.col("node").alias("dst"), "dist")
        onwards = (
            adjacent.join(checked_broadcast(step), "src")
            .join(near_target, "dst")
            .filter(F.col("dist") == F.col("distance") - hop)
            .groupBy("seed", "distance", F.col("dst").alias("node"))
            .agg(F.sum("n_paths").alias("n_paths"))
            .select("seed", "distance", F.lit(hop).alias("hop"), "node", "n_paths")
        )
        onwards = cut_lineage(onwards)
        at = at.unionByName(onwards)
        found = found.unionByName(onwards)
    return found


def _levels_back(adjacent: DataFrame, target: int, depth: int) -> DataFrame:
    """node, dist: distances to the target, up to `depth`."""
    here = adjacent.filter(F.col("src") == target).select(F.col("src").alias("node")).distinct()
    visited = frontier = cut_lineage(here.withColumn("dist", F.lit(0)))
    for hop in range(1, depth + 1):
        reached = adjacent.join(checked_broadcast(frontier.select(F.col("node").alias("src"))), "src")
        new = reached.select(F.col("dst").alias("node")).distinct().join(visited, "node", "left_anti")
        frontier = cut_lineage(new.withColumn("dist", F.lit(hop)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def _levels_ahead(adjacent: DataFrame, seeds: Sequence[int], depth: int) -> DataFrame:
    """seed, hop, node, n_paths: what each seed reaches, and by how many shortest paths."""
    spark = adjacent.sparkSession
    start = spark.createDataFrame([(int(s),) for s in sorted(set(seeds))], "node long")
    known = adjacent.select(F.col("src").alias("node")).join(F.broadcast(start), "node", "left_semi").distinct()
    first = known.select(F.col("node").alias("seed"), F.lit(0).alias("hop"), "node", F.lit(1).cast("long").alias("n_paths"))
    visited = frontier = cut_lineage(first)
    for hop in range(1, depth + 1):
        step = adjacent.join(checked_broadcast(frontier.select("seed", F.col("node").alias("src"), "n_paths")), "src")
        new = step.groupBy("seed", F.col("dst").alias("node")).agg(F.sum("n_paths").alias("n_paths"))
        new = new.join(visited.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = cut_lineage(new.select("seed", F.lit(hop).alias("hop"), "node", "n_paths"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def walks(edges: DataFrame, per_node: int, length: int, seed: int = 0) -> DataFrame:
    """Hash-seeded random walks: (start, walk, path).

    A walker draws the position of its next edge, and joins on (node,
    position). So a hub's walkers spread over its edges, and no task holds all
    neighbours of a hub. Edges stay where they are, in a table bucketed by both;
    a step moves the walkers only.
    """
    directed = cut_lineage(_both_ways(edges).distinct())
    degree = cut_lineage(directed.groupBy("src").agg(F.count("*").alias("degree")))
    placed = number_within(directed, ["src"], "dst", 1 << 20, "pos")
    ends = degree.select(F.col("src").alias("dst"), F.col("degree").alias("dst_degree"))
    steps = placed.join(checked_broadcast(ends), "dst")
    steps = bucketed(steps.select(F.col("src").alias("node"), "pos", "dst", "dst_degree"), ["node", "pos"])
    state = degree.select(
        F.col("src").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("walk"),
        F.col("src").alias("node"), "degree", F.array("src").alias("path"),
    )
    for i in range(1, length):
        state = (
            state.withColumn("pos", drawn("start", "walk", F.lit(i), F.lit(seed)) % F.col("degree"))
            .join(steps, ["node", "pos"])
            .select(
                "start", "walk", F.col("dst").alias("node"), F.col("dst_degree").alias("degree"),
                F.concat("path", F.array("dst")).alias("path"),
            )
        )
    return state.select("start", "walk", "path")


def node_embed(edges: DataFrame, size: int = 8, rounds: int = 3, seed: int = 0) -> DataFrame:
    """Node vectors by iterated sparse random projection: (node, vector array<double>).

    Every node starts with hashed components -1, 0 or 1. A round replaces a node's
    vector by the sum of its neighbours', each weighted by weight / sqrt(strength of
    both ends); nodes with similar surroundings get similar vectors. A round is one
    join and one sum and is stored; nothing is trained or held in one place.
    """
    ends = F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("weight").cast("double").alias("w")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("weight").cast("double").alias("w")),
    )
    directed = edges.select(F.inline(ends))
    strength = cut_lineage(directed.groupBy("src").agg(F.sum("w").alias("s")))
    near = checked_broadcast(strength)
    scaled = (
        directed.join(near, "src")
        .join(near.select(F.col("src").alias("dst"), F.col("s").alias("t")), "dst")
        .select("src", "dst", (F.col("w") / F.sqrt(F.col("s") * F.col("t"))).alias("w"))
    )
    scaled = cut_lineage(scaled)
    names = [f"x{j}" for j in range(size)]
    first = [(drawn("src", F.lit(j), F.lit(seed)) % 3 - 1).cast("double").alias(n) for j, n in enumerate(names)]
    state = strength.select(F.col("src").alias("dst"), *first)
    for _ in range(rounds):
        state = cut_lineage(
            scaled.join(state, "dst")
            .groupBy(F.col("src").alias("_node"))
            .agg(*[F.sum(F.col("w") * F.col(n)).alias(n) for n in names])
            .withColumnRenamed("_node", "dst")
        )
    return state.select(F.col("dst").alias("node"), F.array(*names).alias("vector"))
