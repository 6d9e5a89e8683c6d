"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has 64 bits; bit i is set if it is set in over half of
the hashes of its word shingles. Two fingerprints link if they differ in at most
`radius` bits.

If the bits are dealt into partitions and each gets a threshold so that the
thresholds plus one sum up to radius + 1, any two linked fingerprints agree in at
least one partition up to its threshold; -1 leaves a partition out. So a
fingerprint probes, per partition, the values within the threshold, and every
pair it meets is verified. Correlated bits are put into one block of 16, which
keeps the blocks independent of each other; blocks may be joined to wider
partitions. How often two fingerprints lie within a threshold is estimated from
the histogram of each block (65,536 counts at most); dynamic programming allots
the thresholds, and the cheapest layout is used. More fingerprints make wider
partitions worth their probes, so candidates do not grow with the square.

Equal fingerprints are one node. Links are followed by repeated joins; nothing
per document reaches the driver.

Rows: null or empty text has fingerprint zero; repeated rows share a fingerprint;
a null doc_id is never a component's smallest id unless there is no other; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import ids_and_texts, map_chunks, stored
from touchline.llm.components import components

BITS, BLOCK = 64, 16
SEED = 42
LAYOUTS = (((0,), (1,), (2,), (3,)), ((0, 1), (2,), (3,)), ((0, 1), (2, 3)), ((0, 1, 2), (3,)))
PROBE_COST, PAIR_COST = 4.0, 1.0  # of a shuffled probe against a compared pair
HASHED_AT_ONCE = 1 << 16


def fingerprint(text: str, width: int = 3) -> int:
    """As a signed 64-bit integer. Only A-Z are lower-cased, only ASCII white space parts words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(width, len(words))
    first, last = (ends - lengths)[: len(words) - width + 1], ends[width - 1 :]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), HASHED_AT_ONCE):
        part = slice(at, at + HASHED_AT_ONCE)
        spans = zip(first[part].tolist(), last[part].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(first), bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (signed)."""
    return map_chunks(
        ids_and_texts(docs),
        lambda: lambda ids, texts: {"doc_id": ids, "fp": [fingerprint(t, width) for t in texts]},
        "doc_id long, fp long",
    )


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _sums(nodes: DataFrame, count, size: int) -> np.ndarray:
    """Sum of `count(fingerprints) -> array` over all batches: at most `size` numbers."""
    target = nodes.sparkSession.createDataFrame([], "pos int, n long").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += count(np.ascontiguousarray(batch.column(0).to_numpy()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["pos", "n"])

    rows = nodes.select("fp").mapInArrow(run, target).groupBy("pos").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for pos, n in rows.collect():
        out[pos] = n
    return out


def correlated_blocks(nodes: DataFrame) -> tuple[list[list[int]], int]:
    """Four blocks of 16 bits, correlated ones together, and the number of fingerprints."""

    def count(values: np.ndarray) -> np.ndarray:
        bits = _bits(values).astype(np.float64)
        return np.concatenate([(bits.T @ bits).ravel(), [len(bits)]]).astype(np.int64)

    sums = _sums(nodes, count, BITS * BITS + 1)
    n = max(int(sums[-1]), 1)
    both = sums[:-1].reshape(BITS, BITS) / n
    one = np.diag(both)
    spread = np.sqrt(np.clip(one * (1 - one), 1e-12, None))
    related = np.abs((both - np.outer(one, one)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, blocks = list(range(BITS)), []
    while left:
        block = [max(left, key=lambda b: related[b, left].sum())]
        left.remove(block[0])
        while len(block) < BLOCK:
            best = max(left, key=lambda b: related[b, block].sum())
            block.append(best)
            left.remove(best)
        blocks.append(sorted(block))
    return blocks, int(sums[-1])


def block_distances(nodes: DataFrame, blocks: list[list[int]], radius: int) -> np.ndarray:
    """Per block and d = 0..radius: share of the pairs whose values differ in d bits."""
    weights = (1 << np.arange(BLOCK)).astype(np.int64)
    size = 1 << BLOCK

    def count(values: np.ndarray) -> np.ndarray:
        bits = _bits(values).astype(np.int64)
        return np.concatenate([np.bincount(bits[:, b] @ weights, minlength=size) for b in blocks])

    counts = _sums(nodes, count, size * len(blocks)).reshape(len(blocks), size).astype(float)
    n = max(counts[0].sum(), 1.0)
    values, shares = np.arange(size), np.zeros((len(blocks), radius + 1))
    for d in range(radius + 1):
        for flips in combinations(weights.tolist(), d):
            shares[:, d] += (counts * counts[:, values ^ sum(flips)]).sum(axis=1)
    return shares / n**2


def allot(layout: tuple, shares: np.ndarray, n: int, radius: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost for one layout, by dynamic programming."""
    best = {0: (0.0, [])}
    for part in layout:
        dist = np.array([1.0] + [0.0] * radius)
        for block in part:
            dist = np.convolve(dist, shares[block])[: radius + 1]
        within = np.cumsum(dist)
        new: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, radius - spent + 1):
                probes = sum(comb(BLOCK * len(part), i) for i in range(t + 1))
                own = n * probes * PROBE_COST + (n * n / 2 * within[t] * PAIR_COST if t >= 0 else 0.0)
                total = spent + t + 1
                if total not in new or cost + own < new[total][0]:
                    new[total] = (cost + own, [*chosen, t])
        best = new
    return best[radius + 1]


def partitions(nodes: DataFrame, radius: int) -> list[tuple[int, list[int]]]:
    """Per probed partition: mask (signed) and the flips to probe (signed)."""
    blocks, n = correlated_blocks(nodes)
    shares = block_distances(nodes, blocks, radius)
    plans = [(*allot(layout, shares, n, radius), layout) for layout in LAYOUTS]
    _, thresholds, layout = min(plans, key=lambda p: p[0])
    signed = lambda v: v - (1 << BITS) if v >> (BITS - 1) else v
    out = []
    for part, t in zip(layout, thresholds, strict=True):
        bits = [1 << b for block in part for b in blocks[block]]
        if t >= 0:
            flips = [signed(sum(c)) for i in range(t + 1) for c in combinations(bits, i)]
            out.append((signed(sum(bits)), flips))
    return out


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp, stored) within the radius."""
    parts = partitions(nodes, radius)
    probes = [
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(flip)).alias("value"))
        for i, (mask, flips) in enumerate(parts)
        for flip in flips
    ]
    index = [p for p, flip in zip(probes, [f for _, flips in parts for f in flips], strict=True) if flip == 0]
    left = nodes.select(F.col("fp").alias("a"), F.explode(F.array(*probes)).alias("p"))
    right = nodes.select(F.col("fp").alias("b"), F.explode(F.array(*index)).alias("p"))
    left, right = (d.select(d.columns[0], "p.part", "p.value") for d in (left, right))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    on = (left["part"] == right["part"]) & (left["value"] == right["value"]) & (F.col("a") < F.col("b")) & near
    return left.join(right, on).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every document."""
    own = stored(fingerprints(docs, width))
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(links(nodes, radius))
    # Most fingerprints have no link and meet no join on a root.
    members = linked.select(F.col("node").alias("fp"), "root").join(nodes, "fp")
    roots = members.groupBy("root").agg(F.min("first_id").alias("least"))
    moved = members.join(roots, "root").select("fp", "least")
    named = stored(
        nodes.join(moved, "fp", "left").select("fp", F.coalesce("least", "first_id").alias("component_id"))
    )
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose id is their component's; of rows with the same id one stays.
    Documents without an id cannot be named by a component and stay."""
    kept = near_duplicates(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    first = docs.filter(docs["doc_id"].isNotNull()).dropDuplicates(["doc_id"])
    return first.join(kept, first["doc_id"] == kept["_kept"], "left_semi").unionByName(
        docs.filter(docs["doc_id"].isNull())
    )


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
