"""Nearest neighbours in many dimensions: a forest of random-projection trees with several probes.

In each tree a bucket with more than `leaf` vectors is split at its mean along a random
direction, until it is small. A vector asks in its own bucket of every tree and, where
it lies close to a split, on the other side too. Distances to all vectors of a bucket
asked in are exact; what a search can miss is a neighbour that no tree puts near.
Work grows with n log n and not with n^2; `nearest` is the exact way.

Equal vectors are one vector here. Of them only the k + 1 smallest ids can be among
anyone's k nearest, as ties go to smaller ids, and all of them ask the same question.
So a vector copied a million times is one row in every tree.

Rows: null vectors and those with a null or NaN component take no part; all vectors
must have one length; repeated ids must have one vector; fewer than k others: all of
them; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.neighbours import _distances
from touchline.operators.skew import checked_broadcast
from touchline.session import cut_lineage

TREES, LEAF = 8, 256
SPILL = 0.15  # standard deviations from a split within which a question goes both ways
SPARE = 8  # levels beyond those that halves would need
BLOCK = 4096  # vectors of an unsplittable bucket handled together


def _projected(vectors: DataFrame, trees: int, levels: int, seed: int) -> DataFrame:
    """vec, tree, proj (the vector along the direction of every level of the tree)."""
    length = vectors.agg(F.max(F.size("features"))).first()[0]
    directions = np.random.default_rng(seed).normal(size=(trees, levels, length))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["features"].to_numpy())
                for tree in range(trees):
                    yield pd.DataFrame({"vec": pdf["vec"], "tree": tree, "proj": list(x @ directions[tree].T)})

    return vectors.select("vec", "features").mapInPandas(run, "vec long, tree int, proj array<double>")


def _buckets(projected: DataFrame, levels: int, leaf: int, spill: float) -> tuple[DataFrame, DataFrame]:
    """(vec, tree, bucket) of every vector, and of every question, some in several buckets."""
    start = F.lit(1).cast("long")
    held = cut_lineage(projected.withColumn("bucket", start))
    asked = held
    for level in range(levels):
        x = F.element_at("proj", level + 1)
        split = held.groupBy("tree", "bucket").agg(F.count("*").alias("_n"), F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_sd"))
        split = cut_lineage(split.filter((F.col("_n") > leaf) & (F.col("_sd") > 0)).drop("_n"))
        if split.isEmpty():
            break
        near = checked_broadcast(split)
        right = F.when(x > F.col("_mean"), 1).otherwise(0)
        child = lambda side: F.col("bucket") * 2 + side
        known = F.col("_mean").isNotNull()
        held = cut_lineage(
            held.join(near, ["tree", "bucket"], "left").select(
                "vec", "tree", "proj", F.when(known, child(right)).otherwise(F.col("bucket")).alias("bucket")
            )
        )
        close = F.abs(x - F.col("_mean")) < spill * F.col("_sd")
        ways = F.when(~known, F.array("bucket")).when(close, F.array(child(right), child(1 - right))).otherwise(F.array(child(right)))
        asked = cut_lineage(
            asked.join(near, ["tree", "bucket"], "left").select("vec", "tree", "proj", F.explode(ways).alias("bucket"))
        )
    return held.drop("proj"), asked.drop("proj")


def _best(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of the vectors of a bucket the k + 1 nearest to each question, itself among them."""
    out = []
    if len(left) and len(right):
        ids, y = right["vec"].to_numpy(), np.stack(right["features"].to_numpy())
        for start in range(0, len(left), BLOCK):
            part = left.iloc[start : start + BLOCK]
            x = np.stack(part["_x"].to_numpy())
            best = None
            for other in range(0, len(ids), BLOCK):
                d = _distances(x, y[other : other + BLOCK])
                near = np.broadcast_to(ids[other : other + BLOCK], d.shape)
                if best is not None:
                    d, near = np.hstack([best[0], d]), np.hstack([best[1], near])
                order = np.lexsort((near, d), axis=1)[:, : k + 1]
                best = np.take_along_axis(d, order, axis=1), np.take_along_axis(near, order, axis=1)
            n = best[0].shape[1]
            out.append(pd.DataFrame({"vec": np.repeat(part["_q"].to_numpy(), n), "other": best[1].ravel(), "distance": best[0].ravel()}))
    return pd.concat(out) if out else pd.DataFrame({"vec": [], "other": [], "distance": []})


def nearest_probed(
    df: DataFrame, k: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 0
) -> DataFrame:
    """`df`: id long, features array<double>. Returns id, neighbour, distance, rank 1..k."""
    whole = F.col("features").isNotNull() & ~F.exists("features", lambda v: v.isNull() | F.isnan(v))
    rows = df.select("id", "features").filter(whole & F.col("id").isNotNull()).distinct()
    # vec names a vector by its smallest id.
    named = cut_lineage(rows.groupBy("features").agg(F.min("id").alias("vec"), F.count("*").alias("_n")))
    if named.isEmpty():
        return df.sparkSession.createDataFrame([], "id long, neighbour long, distance double, rank int")
    vectors = named.select("vec", "features")
    copied = checked_broadcast(named.filter("_n > 1").select("features", "vec"))
    owners = rows.join(copied, "features", "left").select("id", F.coalesce("vec", "id").alias("vec"))
    owners = cut_lineage(owners)
    levels = max(ceil(log2(max(vectors.count() / leaf, 1))), 0) + SPARE
    held, asked = _buckets(_projected(vectors, trees, levels, seed), levels, leaf, spill)
    right = held.join(vectors, "vec").groupBy("tree", "bucket")
    asking = asked.select(F.col("tree").alias("_t"), F.col("bucket").alias("_b"), F.col("vec").alias("_q"))
    questions = vectors.select(F.col("vec").alias("_q"), F.col("features").alias("_x"))
    left = asking.join(questions, "_q").groupBy("_t", "_b")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best(a, b, k)

    found = left.cogroup(right).applyInPandas(search, "vec long, other long, distance double")
    # A neighbour found in several trees is one.
    best = W.partitionBy("vec").orderBy("distance", "other")
    near = found.distinct().withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= k + 1)
    # Back to ids: of equal vectors the k + 1 smallest stand for all.
    least = W.partitionBy("vec").orderBy("id")
    few = owners.withColumn("_at", F.row_number().over(least)).filter(F.col("_at") <= k + 1)
    answers = near.drop("_at").join(few.select(F.col("vec").alias("other"), F.col("id").alias("neighbour")), "other")
    top = W.partitionBy("vec").orderBy("distance", "neighbour")
    answers = cut_lineage(
        answers.withColumn("_at", F.row_number().over(top)).filter(F.col("_at") <= k + 1).select("vec", "neighbour", "distance")
    )
    # Every owner of a vector gets its k + 1 answers, without itself.
    mine = owners.join(answers, "vec").filter("id <> neighbour")
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbour"))
    return mine.select("id", "neighbour", "distance", rank.alias("rank")).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (id, neighbour) that were found."""
    both = exact.select("id", "neighbour").join(found.select("id", "neighbour"), ["id", "neighbour"], "left_semi").count()
    return both / max(exact.count(), 1)
