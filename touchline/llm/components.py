"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import stored


def components(pairs: DataFrame) -> DataFrame:
    """node and root (smallest node reachable) of every node in the pairs a, b.

    Each turn takes the least root among the neighbours and then the root of that
    root, which halves long chains. Every turn is stored, so a lost executor costs
    one turn at most. Nodes without a pair do not appear.
    """
    edges = stored(pairs.select("a", "b").union(pairs.select("b", "a")))
    state = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b"))
                   .select("node", F.least("node", "_b").alias("root")))
    while True:
        offered = edges.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(
            F.min("root").alias("_offer")
        )
        nearer = state.join(offered, F.col("node") == F.col("a"), "left").select(
            "node", F.col("root").alias("_old"), F.least("root", "_offer").alias("root")
        )
        above = state.select(F.col("node").alias("_at"), F.col("root").alias("_above"))
        jumped = stored(
            nearer.join(above, F.col("root") == F.col("_at"), "left").select(
                "node", "_old", F.least("root", "_above").alias("root")
            )
        )
        state = jumped.select("node", "root")
        if jumped.filter("_old <> root").isEmpty():
            return state
