"""Co-occurrence queries: suppliers that share orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import embedding, graph
from touchline.plans.registry.common import rounded
from touchline.session import cut_lineage
from touchline.sources.derived import membership, shared_orders

SEEDS, TARGET, HOPS = (1, 2, 4, 5, 7), 10, 6
PER_NODE, LENGTH = 5, 6
SIZE, EMBED_ROUNDS = 8, 3
NEAR, SHIFT = 2, 1.25  # window of the walks, negative samples per pair


def bridges(spark, sf_dir):
    """Between customers that had the same part shipped in the same month."""
    edges = cut_lineage(graph.co_edges(shared_orders(spark, sf_dir)))
    return graph.bridges(edges, SEEDS, TARGET, HOPS)


def _all(spark, sf_dir):
    return cut_lineage(graph.co_edges(membership(spark, sf_dir)))


def walked(spark, sf_dir):
    return _paths(spark, sf_dir).select("start", "walk", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


def _paths(spark, sf_dir):
    return graph.walks(_all(spark, sf_dir), PER_NODE, LENGTH)


def information(spark, sf_dir):
    return rounded(embedding.shifted_pmi(embedding.window_pairs(_paths(spark, sf_dir), NEAR), SHIFT))


def skip_gram(spark, sf_dir):
    found = embedding.walk_vectors(cut_lineage(_paths(spark, sf_dir)), NEAR, SIZE, SHIFT)
    return rounded(found.vectors.select("node", F.posexplode("vector").alias("dim", "x")))


def embedded(spark, sf_dir):
    vectors = graph.node_embed(_all(spark, sf_dir), SIZE, EMBED_ROUNDS)
    return rounded(vectors.select("node", F.posexplode("vector").alias("dim", "x")))


QUERIES = {
    "co_edges": lambda s, d: graph.co_edges(membership(s, d)),
    "bridges": bridges,
    "random_walks": walked,
    "node_embed": embedded,
    "walk_pmi": information,
    "walk_vectors": skip_gram,
}

_E = """WITH RECURSIVE m AS (SELECT DISTINCT l_orderkey AS item, l_suppkey AS member FROM lineitem),
edges AS (SELECT x.member AS a, y.member AS b, count(*) AS weight FROM m x JOIN m y ON x.item = y.item AND x.member < y.member GROUP BY 1, 2)"""

_DIRECTED = """
both_ways AS (SELECT a AS src, b AS dst, weight AS w FROM edges UNION ALL SELECT b, a, weight FROM edges)"""


def _draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 15) AS bigint)"


def _embedding_sql() -> str:
    levels = [f"""e0 AS (SELECT src AS node, j, CAST({_draw("src", "j", "0")} % 3 - 1 AS double) AS x
      FROM strength, (SELECT unnest(range({SIZE})) AS j))"""]
    for k in range(EMBED_ROUNDS):
        levels.append(f"""e{k + 1} AS (SELECT d.src AS node, e.j, sum(d.w / sqrt(s.s * t.s) * e.x) AS x FROM both_ways d
      JOIN strength s ON s.src = d.src JOIN strength t ON t.src = d.dst JOIN e{k} e ON e.node = d.dst GROUP BY 1, 2)""")
    return ",\n".join(levels)


_WALKS = f"""{_E},{_DIRECTED}, adj AS (SELECT DISTINCT src, dst FROM both_ways),
      placed AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos, count(*) OVER (PARTITION BY src) AS degree FROM adj),
      nodes AS (SELECT DISTINCT src, degree FROM placed),
      w AS (SELECT src AS start, walk, src AS node, degree, 1 AS i, CAST(src AS varchar) AS path
          FROM nodes, (SELECT unnest(range(1, {PER_NODE} + 1)) AS walk)
        UNION ALL SELECT w.start, w.walk, p.dst, n.degree, w.i + 1, w.path || '-' || p.dst FROM w
          JOIN placed p ON p.src = w.node AND p.pos = {_draw("w.start", "w.walk", "w.i", "0")} % w.degree
          JOIN nodes n ON n.src = p.dst WHERE w.i < {LENGTH})"""

ORACLE = {
    "random_walks": f"{_WALKS} SELECT start, CAST(walk AS int) AS walk, path FROM w WHERE i = {LENGTH}",
    "walk_pmi": f"""{_WALKS}, p AS (SELECT start, walk, string_split(path, '-') AS nodes FROM w WHERE i = {LENGTH}),
      spot AS (SELECT start, walk, unnest(nodes) AS node, unnest(range(1, len(nodes) + 1)) AS i FROM p),
      c AS (SELECT CAST(x.node AS bigint) AS u, CAST(y.node AS bigint) AS v, count(*) AS n FROM spot x JOIN spot y USING (start, walk)
        WHERE x.i <> y.i AND abs(x.i - y.i) <= {NEAR} GROUP BY 1, 2),
      info AS (SELECT u, v, ln(n * (sum(n) OVER ()) / (1.0 * (sum(n) OVER (PARTITION BY u)) * (sum(n) OVER (PARTITION BY v)))) - ln({SHIFT}) AS pmi FROM c)
      SELECT u, v, round(pmi, 6) AS pmi FROM info WHERE pmi > 0""",
    "node_embed": f"""{_E},{_DIRECTED}, strength AS (SELECT src, CAST(sum(w) AS double) AS s FROM both_ways GROUP BY src),
      {_embedding_sql()}
      SELECT node, CAST(j AS int) AS dim, round(x, 6) + 0.0 AS x FROM e{EMBED_ROUNDS}""",
    "co_edges": f"{_E} SELECT a, b, weight FROM edges",
    "bridges": f"""WITH RECURSIVE m AS (SELECT DISTINCT l_partkey * 100000 + year(l_shipdate) * 12 + month(l_shipdate) AS item, o_custkey AS member
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      adj AS (SELECT DISTINCT x.member AS src, y.member AS dst FROM m x JOIN m y ON x.item = y.item AND x.member <> y.member),
      back AS (SELECT CAST({TARGET} AS bigint) AS node, 0 AS dist UNION
        SELECT adj.dst, back.dist + 1 FROM back JOIN adj ON adj.src = back.node WHERE back.dist < {HOPS}),
      d AS (SELECT node, min(dist) AS dist FROM back GROUP BY node),
      walk AS (SELECT d.node AS seed, d.dist AS distance, 0 AS hop, d.node FROM d WHERE d.node IN {SEEDS} UNION ALL
        SELECT walk.seed, walk.distance, walk.hop + 1, adj.dst FROM walk JOIN adj ON adj.src = walk.node
        JOIN d ON d.node = adj.dst AND d.dist = walk.distance - walk.hop - 1)
      SELECT seed, distance, hop, node, count(*) AS n_paths FROM walk GROUP BY ALL""",
}
