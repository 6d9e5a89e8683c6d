"""Exact k nearest neighbours among the rows of one table.

Rows are assigned to the nearest of a set of pivots that grows with their square root and cells are cut
into blocks of a bounded size. A row's neighbours within its own block bound
the search: it is sent only to tiles (runs of blocks) that hold a block whose cell can
hold something closer (triangle inequality). Nothing but the k best per row and tile
leaves a task, and no batch, tile or matrix in one grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.session import PAIR_ROWS, cut_lineage, setting

MIN_PIVOTS = 256
TILE = 8  # blocks of full size that are searched together
ROUTED = 1 << 14  # rows sent at once by a batch of questions
_CELLS = 1 << 20  # distances held at once
_PAIRS = 1 << 16  # pairs whose differences are held at once


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; differences are squared, not expanded, so that copies get 0."""
    return np.sqrt(np.stack([((b - row) ** 2).sum(axis=1) for row in a])) if len(a) else np.empty((0, len(b)))


def _exact(x: np.ndarray, y: np.ndarray, at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The distances of the pairs (x[at], y[other])."""
    d = np.empty(len(at))
    for start in range(0, len(at), _PAIRS):
        part = slice(start, start + _PAIRS)
        d[part] = np.sqrt(((y[other[part]] - x[at[part]]) ** 2).sum(axis=1))
    return d


def _close(a: np.ndarray, y: np.ndarray, apart: np.ndarray, k: int) -> np.ndarray:
    """Of the pairs `apart` those that can be among the k nearest of their row of `a`.

    Expanded squares are fast but rounded: all within their error of the k-th are kept.
    """
    aa, yy = (a * a).sum(axis=1), (y * y).sum(axis=1)
    if len(y) <= k or not (np.isfinite(aa).all() and np.isfinite(yy).all()):
        return apart
    squares = aa[:, None] + yy - 2 * (a @ y.T)
    squares[~apart] = np.inf
    error = 8 * (a.shape[1] + 8) * np.finfo(float).eps * (aa + yy.max()) + np.finfo(float).tiny
    kth = np.partition(squares, k - 1, axis=1)[:, k - 1]
    return apart & (squares <= (kth + error)[:, None])


def _best(
    ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray, k: int,
    homes: np.ndarray | None = None, other_homes: np.ndarray | None = None,
) -> pd.DataFrame:
    """The k nearest of `other_ids` for each of `ids`, itself and those of its own home left out."""
    out = []
    step = max(1, _CELLS // max(len(y), 1))
    for start in range(0, len(ids), step):
        part = slice(start, start + step)
        apart = ids[part][:, None] != other_ids[None, :]
        if homes is not None:
            apart &= homes[part][:, None] != other_homes[None, :]
        at, other = np.nonzero(_close(x[part], y, apart, k))
        d = _exact(x[part], y, at, other)
        finite = np.isfinite(d)
        at, other, d = at[finite], other[finite], d[finite]
        order = np.lexsort((other_ids[other], d, at))
        at, other, d = at[order], other[order], d[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        out.append(
            pd.DataFrame({"id": ids[part][at[first]], "neighbour": other_ids[other[first]], "distance": d[first]})
        )
    return pd.concat(out) if out else pd.DataFrame({"id": [], "neighbour": [], "distance": []})


def _tiles(stats: dict[int, tuple[int, int]], pivots: np.ndarray, rows: int) -> pd.DataFrame:
    """cell, block, tile, home (a number of the block): blocks of cells that lie at a like
    distance from the first pivot share tiles of about `rows` rows. `stats`: blocks and rows by cell."""
    cells = np.array(list(stats), np.int64)
    cells = cells[np.argsort(_distances(pivots[:1], pivots)[0][cells], kind="stable")]
    n_blocks = np.array([stats[c][0] for c in cells])
    size = np.repeat(np.array([stats[c][1] for c in cells]) / n_blocks, n_blocks)
    first = np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    tile = np.unique(np.floor((np.cumsum(size) - size) / rows), return_inverse=True)[1]
    home = np.arange(len(size))
    return pd.DataFrame({"cell": np.repeat(cells, n_blocks), "block": home - first, "tile": tile, "home": home})


def _routed(batch: pd.DataFrame, pivots: np.ndarray, placed: pd.DataFrame, radii: np.ndarray) -> Iterator[pd.DataFrame]:
    """The rows of a batch, once for each tile with a block within their bound, at most `ROUTED`
    at once (or one row's). `radii`: of the cell of each block in `placed`."""
    names, homes = placed["cell"].to_numpy(), placed["home"].to_numpy()
    starts = np.searchsorted(placed["tile"].to_numpy(), np.arange(placed["tile"].max() + 1))
    step = max(1, ROUTED // len(starts))
    for start in range(0, len(batch), step):
        pdf = batch.iloc[start : start + step]
        features, home = pdf["features"].to_numpy(), pdf["home"].to_numpy()
        d = _distances(np.stack(features), pivots)
        reach = pdf["bound"].fillna(np.inf).to_numpy() * (1 + 1e-12) + 1e-12
        near = (d[:, names] - radii <= reach[:, None]) & (home[:, None] != homes)
        at, tile = np.nonzero(np.logical_or.reduceat(near, starts, axis=1))
        yield pd.DataFrame(
            {
                "id": pdf["id"].to_numpy()[at],
                "features": features[at],
                "home": home[at].astype("int32"),
                "tile": tile.astype("int32"),
            }
        )


def nearest(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """`df`: id long, features array<double>. Returns id, neighbour, distance, rank 1..k."""
    spark = df.sparkSession
    block_rows = setting(spark, PAIR_ROWS)
    n = df.count()
    if n == 0:
        return spark.createDataFrame([], "id long, neighbour long, distance double, rank int")
    # One per block, up to the square root of the rows: cells shrink as rows grow.
    n_pivots = max(1, min(n // block_rows, max(MIN_PIVOTS, isqrt(n))))
    by_hash = df.orderBy(F.xxhash64("id", F.lit(seed)), "id")
    picked = by_hash.limit(n_pivots).select("features").collect()
    pivots = np.array([r["features"] for r in picked])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, step = np.stack(pdf["features"].to_numpy()), max(1, _CELLS // len(pivots))
                near = []
                for start in range(0, len(x), step):
                    d = _distances(x[start : start + step], pivots)
                    near.append((d.argmin(axis=1).astype("int32"), d.min(axis=1)))
                pdf["cell"] = np.concatenate([cell for cell, _ in near])
                pdf["to_pivot"] = np.concatenate([d for _, d in near])
                yield pdf

    rows = cut_lineage(
        df.select("id", "features").mapInPandas(
            assign, "id long, features array<double>, cell int, to_pivot double"
        )
    )
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("to_pivot").alias("radius"))
    # One row per pivot.
    found = cells.collect()
    stats = {r["cell"]: (-(-r["n"] // block_rows), r["n"]) for r in found}
    blocks = spark.createDataFrame([(c, b) for c, (b, _) in stats.items()], "cell int, _blocks int")
    rows = rows.join(F.broadcast(blocks), "cell").withColumn(
        "block", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("_blocks")).cast("int")
    ).drop("_blocks")

    result = "id long, neighbour long, distance double"
    best_first = W.partitionBy("id").orderBy("distance", "neighbour")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["id"].to_numpy(), np.stack(pdf["features"].to_numpy())
        return _best(ids, x, ids, x, k)

    near = cut_lineage(rows.groupBy("cell", "block").applyInPandas(within, result))
    if len(stats) == 1 and stats[next(iter(stats))][0] == 1:
        return near.withColumn("rank", F.row_number().over(best_first))
    bound = near.groupBy("id").agg(F.count("*").alias("_n"), F.max("distance").alias("_d"))
    bounded = rows.join(
        bound.select("id", F.when(F.col("_n") >= k, F.col("_d")).alias("bound")), "id", "left"
    )
    wanted = "id long, features array<double>, home int, tile int"

    placed = _tiles(stats, pivots, TILE * block_rows)
    radii = placed["cell"].map({r["cell"]: r["radius"] for r in found}).to_numpy("float64")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _routed(batch, pivots, placed, radii)

    # One row per block.
    at_home = F.broadcast(spark.createDataFrame(placed, "cell int, block int, tile int, home int"))
    # All rows may want one tile: they are spread over salts of a bounded share.
    n_salts = n // (16 * block_rows) + 1
    salts = F.sequence(F.lit(0), F.lit(n_salts - 1))
    asking = bounded.join(at_home, ["cell", "block"]).select("id", "features", "bound", "home").mapInPandas(route, wanted)
    asking = asking.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(n_salts)).cast("int"))
    holding = rows.join(at_home, ["cell", "block"]).select("tile", "home", "id", "features", F.explode(salts).alias("salt"))

    def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        return _best(
            left["id"].to_numpy(), np.stack(left["features"].to_numpy()),
            right["id"].to_numpy(), np.stack(right["features"].to_numpy()), k,
            left["home"].to_numpy(), right["home"].to_numpy(),
        )

    keys = ["tile", "salt"]
    far = asking.groupBy(*keys).cogroup(holding.groupBy(*keys)).applyInPandas(across, result)
    return (
        near.unionByName(far)
        .withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= k)
    )
