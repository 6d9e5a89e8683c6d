"""Permutation test of a group contrast per edge, as a matrix product.

Relabelling the subjects in many rounds is a 0/1 matrix of subjects by rounds. Its
transpose times the values (subjects by a tile of edges) gives the sums of group 1
of every round at once. Each task multiplies the rows it holds and emits one row
per edge, whatever the number of rounds; these few rows are all that is shuffled.

Rows: null values do not count; an edge needs two subjects in each group; subjects
without a group are left out; a round with fewer than two values in a group has no
say; with a null t (no variance at all) p is null; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.draws import drawn
from touchline.operators.skew import checked_broadcast

EDGE_TILE = 64
HELD_EDGES = 20_000  # sums of a task before it emits them
BINS = 48  # draws have 60 bits; the upper 12 are counted first
FLAT = 1e-12  # share of the square sum below which a variance is rounding
TOTAL, OBSERVED = 0, 1  # columns of the matrix before the rounds


def cutoffs(groups: DataFrame, rounds: int, seed: int) -> list:
    """Per round the draw and subject up to which subjects are in group 1, `rounds` rows.

    Its size is that of the real group 1. Draws are counted by their upper bits, then
    only those in the bin that holds the cutoff are put in order.
    """
    n1 = groups.filter("grp = 1").count()
    turns = groups.select("subject", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    turns = turns.withColumn("_h", drawn("subject", "round", F.lit(seed))).withColumn("_bin", F.shiftright("_h", BINS))
    counts = turns.groupBy("round", "_bin").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy("round").orderBy("_bin"))
    cut = counts.withColumn("_need", n1 - (upto - F.col("_c"))).filter((F.col("_need") > 0) & (F.col("_need") <= F.col("_c")))
    near = turns.join(F.broadcast(cut.drop("_c")), ["round", "_bin"])
    place = F.row_number().over(W.partitionBy("round").orderBy("_h", "subject"))
    return near.withColumn("_at", place).filter("_at = _need").select("round", "_h", "subject").orderBy("round").collect()


def members(groups: DataFrame, rounds: int, seed: int) -> DataFrame:
    """subject and its row of the matrix: 1, whether it is in group 1, and the rounds."""
    found = cutoffs(groups, rounds, seed)
    limits = F.array(
        *[F.struct(F.lit(r["round"]).alias("k"), F.lit(r["_h"]).alias("h"), F.lit(r["subject"]).alias("s")) for r in found]
    )

    def drawn_in(limit):
        h = drawn("subject", limit["k"], F.lit(seed))
        return (h < limit["h"]) | ((h == limit["h"]) & (F.col("subject") <= limit["s"]))

    fixed = F.array(F.lit(True), F.col("grp") == 1)
    row = F.concat(fixed, F.transform(limits, drawn_in)) if found else fixed
    return groups.filter("grp IN (0, 1)").select("subject", row.alias("row"))


def _matrix(lists: pa.Array, dtype: str) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(lists), -1)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of 1, x and x * x over the subjects of each column of the matrix, per edge."""
    held: dict[tuple, np.ndarray] = {}

    def emitted() -> pa.RecordBatch:
        sums = [list(v.ravel()) for v in held.values()]
        return pa.RecordBatch.from_pydict(
            {"src": pa.array([k[0] for k in held]), "dst": pa.array([k[1] for k in held]),
             "sums": pa.array(sums, pa.list_(pa.float64()))}
        )

    for batch in batches:
        rows = _matrix(batch.column("row"), "float64")
        pdf = batch.select(["src", "dst", "subject", "x"]).to_pandas()
        edge = pdf.groupby(["src", "dst"], sort=False).ngroup().to_numpy()
        order = np.argsort(edge, kind="stable")
        tiles = np.searchsorted(edge[order], np.arange(0, edge.max(initial=-1) + 1 + EDGE_TILE, EDGE_TILE))
        for start, end in zip(tiles[:-1], tiles[1:], strict=True):
            at = order[start:end]
            if not len(at):
                continue
            who, first, subject = np.unique(pdf["subject"].to_numpy()[at], return_index=True, return_inverse=True)
            x, column = pdf["x"].to_numpy()[at], edge[at] - edge[at[0]]
            values = np.zeros((3, len(who), column.max() + 1))
            for power in range(3):
                np.add.at(values[power], (subject, column), x**power)
            matrix = rows[at[first]].T
            sums = np.stack([matrix @ v for v in values])  # power, round, edge
            _, one = np.unique(column, return_index=True)
            for k, i in enumerate(at[one]):
                key = pdf["src"].iat[i], pdf["dst"].iat[i]
                held[key] = held[key] + sums[:, :, k] if key in held else sums[:, :, k]
        if len(held) > HELD_EDGES:
            yield emitted()
            held.clear()
    if held:
        yield emitted()


def _verdicts(keys: list[tuple], sums: list[np.ndarray]) -> pa.RecordBatch:
    n, s, q = np.stack(sums).reshape(len(sums), 3, -1).transpose(1, 0, 2)

    def mean_var(n, s, q):
        v = (q - s * s / n) / (n - 1)
        return s / n, np.where(v <= FLAT * np.abs(q), 0.0, v) / n

    rest = [c[:, [TOTAL]] - c[:, OBSERVED:] for c in (n, s, q)]
    with np.errstate(divide="ignore", invalid="ignore"):
        m1, v1 = mean_var(n[:, OBSERVED:], s[:, OBSERVED:], q[:, OBSERVED:])
        m0, v0 = mean_var(*rest)
        t = (m1 - m0) / np.sqrt(v1 + v0)
    enough = (n[:, OBSERVED:] > 1.5) & (rest[0] > 1.5)
    valid = enough & np.isfinite(t)
    seen, draws = t[:, 0], np.abs(t[:, 1:])
    rounds = valid[:, 1:].sum(axis=1)
    hits = (valid[:, 1:] & (draws >= np.abs(seen)[:, None] * (1 - 1e-9))).sum(axis=1)
    keep = enough[:, 0]
    known = valid[:, 0][keep]
    return pa.RecordBatch.from_pydict(
        {
            "src": pa.array([k[0] for k, ok in zip(keys, keep, strict=True) if ok], pa.string()),
            "dst": pa.array([k[1] for k, ok in zip(keys, keep, strict=True) if ok], pa.string()),
            "t": pa.array(seen[keep], mask=~known),
            "rounds": pa.array(rounds[keep].astype("int64")),
            "p": pa.array(((1 + hits) / (1 + rounds))[keep], mask=~known),
        }
    )


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of their edges: add up those of an edge, then test it."""
    key, total = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist(), strict=True))
        sums = _matrix(batch.column("sums"), "float64")
        starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]]
        added = list(np.add.reduceat(sums, starts, axis=0))
        names = [keys[i] for i in starts]
        if key is not None:
            if key == names[0]:
                added[0] = added[0] + total
            else:
                names.insert(0, key)
                added.insert(0, total)
        key, total = names.pop(), added.pop()
        if names:
            yield _verdicts(names, added)
    if key is not None:
        yield _verdicts([key], [total])


def permutation_test(edges: DataFrame, groups: DataFrame, rounds: int, seed: int = 0, value: str = "r") -> DataFrame:
    """src, dst, t (Welch, observed), rounds that count, and p."""
    x = F.col(value).cast("double")
    rows = edges.filter(x.isNotNull() & ~F.isnan(x)).select("subject", "src", "dst", x.alias("x"))
    placed = rows.join(checked_broadcast(members(groups, rounds, seed)), "subject").select("src", "dst", "subject", "x", "row")
    partial = placed.mapInArrow(_partial, "src string, dst string, sums array<double>")
    together = partial.repartition("src", "dst").sortWithinPartitions("src", "dst")
    return together.mapInArrow(_combined, "src string, dst string, t double, rounds long, p double")
