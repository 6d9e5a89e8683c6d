"""Node vectors from walks: what skip-gram training fits, solved as a factorisation.

Skip-gram with k negative samples factors the pointwise mutual information of nodes
and their context, shifted by log k (Levy and Goldberg 2014). Here the pairs within
a window of every walk are counted, the positive part of the shifted information is
kept as a sparse symmetric matrix, and its leading singular vectors are found by
randomised subspace iteration (Halko, Martinsson and Tropp 2011).

A product with the matrix is a join and a sum. Tall matrices stay tables of one row
per node; they are made orthonormal through the triangular factors of their
partitions, which are merged in a tree. The driver sees small square matrices only.

Rows: an empty edge or walk table gives empty results; a node without a positive
entry has the zero vector; null paths and null nodes in a path are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.draws import drawn
from touchline.operators.skew import checked_broadcast
from touchline.session import cut_lineage

FAN = 32  # triangular factors merged by one task
EMPTY = 1e-10  # directions below this share of the largest one are no directions
CLEAR = 1e-4  # if all are above this share, one pass makes them orthonormal to 12 digits


def window_pairs(walks: DataFrame, window: int) -> DataFrame:
    """u, v, n: how often v stands at most `window` places from u on a walk, both ways round."""
    path = F.filter("path", lambda x: x.isNotNull())
    placed = walks.select(path.alias("path")).select("path", F.posexplode("path").alias("_i", "u"))
    near = placed.select("u", F.explode(F.slice("path", F.col("_i") + 2, F.lit(window))).alias("v"))
    # Each pair of places once, then both ways: half the rows reach the shuffle.
    counts = near.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count("*").alias("n"))
    ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    # A node beside itself has one entry, which counts both ways.
    one = F.when(F.col("a") == F.col("b"), F.slice(ways, 1, 1)).otherwise(ways)
    return counts.select(F.inline(one), F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")).alias("n"))


def shifted_pmi(pairs: DataFrame, shift: float = 1.0) -> DataFrame:
    """u, v, pmi: log(n total / (n_u n_v)) - log(shift), where that is above 0."""
    pairs = cut_lineage(pairs)
    sums = cut_lineage(pairs.groupBy("u").agg(F.sum("n").alias("n_u")))
    total = sums.agg(F.sum("n_u")).first()[0] or 0
    sums = checked_broadcast(sums)
    known = pairs.join(sums, "u").join(sums.select(F.col("u").alias("v"), F.col("n_u").alias("n_v")), "v")
    value = F.log(F.col("n") * F.lit(float(total)) / (F.col("n_u").cast("double") * F.col("n_v"))) - float(np.log(shift))
    return known.select("u", "v", value.alias("pmi")).filter("pmi > 0")


def _names(n: int) -> list[str]:
    return [f"x{j}" for j in range(n)]


def _times(matrix: DataFrame, tall: DataFrame, n: int) -> DataFrame:
    """The sparse matrix times a tall one, stored."""
    names = _names(n)
    rows = matrix.join(tall.withColumnRenamed("node", "v"), "v")
    sums = [F.sum(F.col("pmi") * F.col(c)).alias(c) for c in names]
    return cut_lineage(rows.groupBy(F.col("u").alias("node")).agg(*sums))


def _tall(tall: DataFrame, right: np.ndarray) -> DataFrame:
    """A tall matrix times a small one."""
    n, m = right.shape
    old, new = _names(n), _names(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in old]) @ right
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), *[pa.array(rows[:, j]) for j in range(m)]], names=["node", *new]
            )

    node = dict(tall.dtypes)["node"]
    return tall.mapInArrow(run, ", ".join([f"node {node}", *[f"{c} double" for c in new]]))


def triangle(tall: DataFrame, n: int, fan: int = FAN) -> np.ndarray:
    """R of the QR factorisation of all rows, n by n: factors of partitions, merged `fan` at a time."""
    names = _names(n)
    schema = "part long, " + ", ".join(f"{c} double" for c in names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, n))
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            r = np.linalg.qr(np.vstack([r, rows]), mode="r")
        part = np.full(len(r), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(r[:, j]) for j in range(n)]], names=["part", *names])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(pdf[names].to_numpy(), mode="r")
        return pd.DataFrame(r, columns=names).assign(part=int(pdf["part"].iloc[0]) // fan)[["part", *names]]

    factors = cut_lineage(tall.mapInArrow(local, schema))
    while factors.select("part").distinct().limit(fan + 1).count() > fan:
        factors = cut_lineage(factors.groupBy(F.floor(F.col("part") / fan)).applyInPandas(merge, schema))
    rows = np.array([[r[c] for c in names] for r in factors.collect()], dtype="float64").reshape(-1, n)
    return np.linalg.qr(np.vstack([rows, np.zeros((n, n))]), mode="r")


def _orthonormal(tall: DataFrame, r: np.ndarray) -> tuple[DataFrame, int]:
    """An orthonormal basis of the columns, given their triangle, and its size. Where the
    columns nearly coincide, a second pass takes off what rounding left."""
    while True:
        _, s, vt = np.linalg.svd(r)
        kept = s > EMPTY * max(s[0], np.finfo(float).tiny)
        tall, n = _tall(tall, vt[kept].T / s[kept]), int(kept.sum())
        if not n or s[kept][-1] > CLEAR * s[0]:
            return tall, n
        tall = cut_lineage(tall)
        r = triangle(tall, n)


@dataclass(frozen=True)
class Spectrum:
    """vectors: node, vector array<double> (left singular vectors times the square roots
    of the singular values); values: the leading singular values, greatest first."""

    vectors: DataFrame
    values: list[float]


def factorised(
    matrix: DataFrame, size: int, spare: int = 8, rounds: int = 4, tolerance: float = 1e-9, seed: int = 0
) -> Spectrum:
    """Leading singular values and vectors of a symmetric matrix (u, v, pmi).

    The subspace has `spare` more directions than asked for. Rounds stop when the
    values settle within `tolerance`, at the latest after `rounds`.
    """
    matrix = cut_lineage(matrix)
    nodes = matrix.select(F.col("u").alias("node")).distinct()
    n = size + spare
    start = [((drawn("node", F.lit(j), F.lit(seed)) % 2001) / 1000.0 - 1.0).alias(c) for j, c in enumerate(_names(n))]
    first = cut_lineage(nodes.select("node", *start))
    basis, n = _orthonormal(first, triangle(first, n))
    values = np.zeros(0)
    for _ in range(rounds):
        if not n:
            break
        image = _times(matrix, basis, n)
        r = triangle(image, n)
        before, values = values, np.linalg.svd(r, compute_uv=False)[:size]
        settled = len(before) == len(values) and np.all(np.abs(values - before) <= tolerance * values[0])
        basis, n = _orthonormal(image, r)
        if settled:
            break
    if not n:
        return Spectrum(nodes.select("node", F.array().cast("array<double>").alias("vector")).limit(0), [])
    # basis' matrix = (triangle' q'), so its left singular vectors turn the basis into those of the matrix.
    image = _times(matrix, basis, n)
    left, values, _ = np.linalg.svd(triangle(image, n).T)
    kept = values > EMPTY * values[0]
    kept[size:] = False
    values = values[kept]
    turned = _tall(basis, left[:, kept] * np.sqrt(values))
    names = _names(len(values))
    # A singular vector has no sign of its own: the one with the greater cubes is taken.
    cubes = turned.agg(*[F.sum(F.pow(c, F.lit(3))).alias(c) for c in names]).first()
    signed = [F.col(c) * (-1.0 if cubes[c] < 0 else 1.0) for c in names]
    return Spectrum(turned.select("node", F.array(*signed).alias("vector")), [float(v) for v in values])


def walk_vectors(
    walks: DataFrame, window: int, size: int, shift: float = 1.0, rounds: int = 4, seed: int = 0
) -> Spectrum:
    """Vectors of all nodes on the walks; those without a positive entry are zero."""
    pairs = window_pairs(walks, window)
    found = factorised(shifted_pmi(pairs, shift), size, rounds=rounds, seed=seed)
    nodes = walks.select(F.explode("path").alias("node")).filter("node IS NOT NULL").distinct()
    zero = F.array_repeat(F.lit(0.0), len(found.values))
    every = nodes.join(found.vectors, "node", "left").select("node", F.coalesce("vector", zero).alias("vector"))
    return Spectrum(every, found.values)
