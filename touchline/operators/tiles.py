"""Blocked matrix products over panels (keys, region, t, x), one row per cell.

The regions of a subject are numbered and cut into tiles, time is cut into blocks.
Each sample is sent to the tile pairs it takes part in; a task holds the samples of
two tiles in one block (or of many small subjects together) and multiplies them.
Nothing holds all regions of a subject, or all of its time, at once.

Rows: null and NaN samples count as absent; rows without a key or region, or without
t, are left out; the cells of a panel must be unique; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.skew import checked_broadcast
from touchline.session import cut_lineage

TILE, BLOCK = 64, 1024
GROUP_ROWS = 100_000  # samples of small subjects that share a group
A_SIDE, B_SIDE, BOTH = 0, 1, 2


@dataclass(frozen=True)
class Part:
    """Samples of the regions of one tile: rows are times, gaps are 0 in `v` and `m`."""

    regions: np.ndarray
    v: np.ndarray
    m: np.ndarray


@dataclass(frozen=True)
class Cell:
    """What a task sees of one subject: two tiles (the same object twice on the
    diagonal), the times, and where the block and the subject begin and end."""

    a: Part
    b: Part
    times: np.ndarray
    block: int
    first: int
    last: int


def described(panel: DataFrame, keys: Sequence[str], tile: int, block: int) -> DataFrame:
    """One row per series: mean, deviation, the region's number, the subject's number of
    tiles and its first and last block."""
    series = panel.groupBy(*keys, "region").agg(
        F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"), F.count("*").alias("_n"),
        F.min("t").alias("_from"), F.max("t").alias("_to"),
    )
    own = W.partitionBy(*keys)
    numbered = series.withColumns(
        {
            "_i": F.row_number().over(own.orderBy("region")) - 1,
            "_tiles": F.ceil(F.count("*").over(own) / F.lit(tile)).cast("int"),
            "_first": F.floor(F.min("_from").over(own) / F.lit(block)).cast("long"),
            "_last": F.floor(F.max("_to").over(own) / F.lit(block)).cast("long"),
        }
    )
    return cut_lineage(numbered.drop("_from", "_to"))


def _places(own: Column, tiles: Column) -> Column:
    """The tile pairs (a <= b) of a tile, and the side it is on in each."""

    def place(other: Column) -> Column:
        side = F.when(other == own, BOTH).when(other > own, A_SIDE).otherwise(B_SIDE)
        named = zip(("a", "b", "side"), (F.least(own, other), F.greatest(own, other), side), strict=True)
        return F.named_struct(*[c for name, value in named for c in (F.lit(name), value)])

    return F.transform(F.sequence(F.lit(0), tiles - 1), place)


def sent(
    panel: DataFrame, keys: Sequence[str], tile: int, block: int, lag: int = 0, scaled: bool = True
) -> DataFrame:
    """Every sample in each group that needs it, as z-score of its series if `scaled`.
    With a lag, samples also go to the block that their lagged use falls into."""
    known = panel.select(*keys, "region", F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"))
    known = known.filter("x IS NOT NULL AND NOT isnan(x) AND t IS NOT NULL")
    series = described(known, keys, tile, block)
    total = series.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    buckets = int(total // GROUP_ROWS + 1)
    x = F.col("x")
    if scaled:
        x = (x - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    at = lambda t: F.floor(t / F.lit(block)).cast("long")
    blocks = F.array(at(F.col("t"))) if lag == 0 else F.array_distinct(F.array(at(F.col("t")), at(F.col("t") + lag)))
    rows = known.join(checked_broadcast(series), [*keys, "region"])
    rows = rows.select(
        *keys, "region", "t", x.alias("x"), "_first", "_last",
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"),
        F.explode(blocks).alias("block"),
        _places(F.floor(F.col("_i") / F.lit(tile)).cast("int"), F.col("_tiles")).alias("_places"),
    )
    return rows.withColumn("_place", F.explode("_places")).select(
        *keys, "region", "t", "x", "_first", "_last", "bucket", "block", "_place.*"
    )


def _part(region: np.ndarray, at: np.ndarray, x: np.ndarray, times: int) -> Part:
    regions, column = np.unique(region, return_inverse=True)
    v, m = np.zeros((times, len(regions))), np.zeros((times, len(regions)))
    v[at, column], m[at, column] = x, 1.0
    return Part(regions, v, m)


def cells(pdf: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[tuple, Cell]]:
    """The subjects of a group, one after the other."""
    columns = {c: pdf[c].to_numpy() for c in (*keys, "region", "t", "x", "side", "block", "_first", "_last")}
    for where in pdf.groupby(list(keys), sort=False).indices.values():
        own = {c: v[where] for c, v in columns.items()}
        times, at = np.unique(own["t"], return_inverse=True)

        def part(side: int, own=own, at=at, n=len(times)) -> Part:
            rows = (own["side"] == side) | (own["side"] == BOTH)
            return _part(own["region"][rows], at[rows], own["x"][rows], n)

        a = part(A_SIDE)
        b = a if own["side"][0] == BOTH else part(B_SIDE)
        key = tuple(own[k][0] for k in keys)
        yield key, Cell(a, b, times, int(own["block"][0]), int(own["_first"][0]), int(own["_last"][0]))


def over_cells(
    rows: DataFrame, keys: Sequence[str], columns: str, work: Callable[[Cell], dict[str, np.ndarray]]
) -> DataFrame:
    """The keys and what `work` gives for each cell, as rows."""
    keys = list(keys)
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], columns])
    names = [c.split()[0] for c in columns.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {c: [] for c in (*keys, *names)}
        for key, cell in cells(pdf, keys):
            out = work(cell)
            n = len(out[names[0]])
            if n:
                for k, value in zip(keys, key, strict=True):
                    found[k].append(np.full(n, value))
                for c in names:
                    found[c].append(out[c])
        empty = pd.Series([], dtype="object")
        return pd.DataFrame({c: np.concatenate(v) if v else empty for c, v in found.items()})

    return rows.groupBy("bucket", "a", "b", "block").applyInPandas(run, schema)


def products(
    panel: DataFrame,
    keys: Sequence[str],
    names: Sequence[str],
    fn: Callable[[Part, Part, np.ndarray], dict[str, np.ndarray]],
    ordered: bool = False,
    lag: int = 0,
    tile: int = TILE,
    block: int = BLOCK,
) -> DataFrame:
    """Per pair of regions the sums over time of `fn`'s matrices (rows: the first part).

    The first of `names` counts samples; pairs without any are left out. Ordered
    pairs come both ways, others with src < dst. `fn` gets the parts and, per row,
    the number of the row `lag` before it (-1: none), for the rows that belong to the block.
    """

    def work(cell: Cell) -> dict[str, np.ndarray]:
        before = np.full(len(cell.times), -1)
        if lag:
            at = np.searchsorted(cell.times, cell.times - lag)
            hit = (cell.times[np.minimum(at, len(at) - 1)] == cell.times - lag) & (cell.times >= cell.block * block)
            before[hit] = at[hit]
        out: dict[str, list] = {c: [] for c in ("src", "dst", *names)}
        ways = [(cell.a, cell.b)] if cell.a is cell.b or not ordered else [(cell.a, cell.b), (cell.b, cell.a)]
        for a, b in ways:
            sums = fn(a, b, before)
            some = sums[names[0]] > 0
            if a is b:
                some &= ~np.eye(len(a.regions), dtype=bool) if ordered else np.triu(np.ones_like(some), 1).astype(bool)
            i, j = np.nonzero(some)
            out["src"].append(a.regions[i])
            out["dst"].append(b.regions[j])
            for c in names:
                out[c].append(sums[c][i, j])
        return {c: np.concatenate(v) for c, v in out.items()}

    columns = "src string, dst string, " + ", ".join(f"{c} double" for c in names)
    partial = over_cells(sent(panel, keys, tile, block, lag), keys, columns, work)
    return partial.groupBy(*keys, "src", "dst").agg(*[F.sum(c).alias(c) for c in names])
