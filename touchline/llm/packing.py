"""Vector best-fit packing of documents into sequences of bounded size.

A piece asks for three things of a sequence: tokens, a document slot, and
attention cost (its length squared). All three follow from its length, and a
length is at most the token capacity; so the plan is made on the histogram of
lengths, a table that the capacity bounds whatever the input. A sequence is
filled one piece at a time: of the lengths that fit under every constraint, the
one with the best score is taken, by either rule:

* `dot`: largest weighted dot product of the demand and what is still free,
* `norm`: smallest weighted norm of what would remain free.

The filled sequence is repeated as often as the counts allow, which uses up at
least one length, so there are at most as many patterns as lengths. Both rules
are planned and the one with fewer sequences is taken.

Pieces then take their places by rank within their length. Ranks are counted in
parts of a length, so that no task holds all pieces of one length.

Rows: null or empty text is one piece holding only the end id; repeated rows are
packed each; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.byte_bpe import encoder
from touchline.llm.common import ids_and_texts, map_chunks, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PARTS = 4096  # ranks are counted in about so many parts, at most one length each


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. None: no limit beyond that of the tokens."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)

    def limits(self) -> np.ndarray:
        return np.array(
            [self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64
        )

    def longest(self) -> int:
        """Longest piece that fits into a sequence of its own."""
        return min(self.tokens, int(np.sqrt(self.limits()[2])))


def cut(docs: DataFrame, path: str, end_id: int = 0, longest: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `longest` ids. Only longer documents are cut, from the end,
    so the first piece may be shorter. `with_ids` adds the ids, packed."""
    end = int(end_id).to_bytes(4, "little")

    def make():
        to_ids = encoder(path)

        def work(ids: list, texts: list[str]) -> dict:
            rows = []
            for doc, packed in zip(ids, to_ids(texts), strict=True):
                packed += end
                n = len(packed) // 4
                first = n % longest or longest
                starts = [0, *range(first, n, longest)]
                for piece, start in enumerate(starts):
                    stop = first if piece == 0 else start + longest
                    own = packed[start * 4 : stop * 4]
                    rows.append((doc, piece, start, len(own) // 4, zlib.crc32(own), own))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            return dict(zip(names, columns, strict=True))

        return work

    return map_chunks(ids_and_texts(docs), make, PIECES + (", ids binary" if with_ids else ""))


def plan(counts: dict[int, int], capacity: Capacity, rule: str) -> list[tuple[int, list[int]]]:
    """Patterns as (repetitions, lengths in order)."""
    sizes = np.array(sorted(counts, reverse=True), np.int64)
    left = np.array([counts[s] for s in sizes.tolist()], np.int64)
    demand = np.stack([sizes, np.ones_like(sizes), sizes**2], axis=1)
    limits = capacity.limits()
    share = demand / limits
    weights = np.array(capacity.weights)
    patterns = []
    while left.any():
        free, used, order = limits.copy(), np.zeros_like(left), []
        open_ = left > 0
        while True:
            fits = np.flatnonzero(open_ & (demand <= free).all(axis=1))
            if not len(fits):
                break
            room = free / limits
            if rule == "dot":
                score = share[fits] @ (weights * room)
            else:
                score = -(((room - share[fits]) ** 2) @ weights)
            best = fits[np.argmax(score)]  # ties: the longer piece
            order.append(int(sizes[best]))
            free -= demand[best]
            used[best] += 1
            open_[best] = used[best] < left[best]
        if not order:
            raise ValueError("a piece is larger than a sequence")
        held = used > 0
        times = int((left[held] // used[held]).min())
        left -= used * times
        patterns.append((times, order))
    return patterns


def best_plan(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, list[int]]]:
    plans = [plan(counts, capacity, rule) for rule in ("norm", "dot")]
    return min(plans, key=lambda p: sum(times for times, _ in p))


def places(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where the pieces of a
    length go, rank by rank."""
    rows, seen, sequence = [], {}, 0
    for times, order in patterns:
        offset = 0
        for size in order:
            rank = seen.get(size, 0)
            rows.append((size, rank, sequence, offset))
            seen[size] = rank + times
            offset += size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: Capacity | None = None) -> DataFrame:
    """Add sequence_id and offset to stored pieces (doc_id, piece, start, length, ...)."""
    capacity = capacity or Capacity()
    spark = pieces.sparkSession
    # At most one row per length up to the capacity.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(best_plan(counts, capacity))
    part_rows = max(256, sum(counts.values()) // PARTS)
    salts = spark.createDataFrame(
        [(size, -(-n // part_rows)) for size, n in counts.items()], "length long, _parts long"
    )
    # Both small tables are bounded: one row per length, and about PARTS more.
    parted = pieces.join(F.broadcast(salts), "length").withColumn(
        "_part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_parts"))
    ).drop("_parts")
    sizes = parted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = parted.withColumn(
        "_rank", F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "piece"))
    ).join(F.broadcast(before), ["length", "_part"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") - 1 + F.col("_before")).alias("_rank"))
    target = spark.createDataFrame([], pieces.schema).withColumns(
        {"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}
    ).schema
    shared = spark.sparkContext.broadcast(table)
    names = list(pieces.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        keys = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            size = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            at = np.searchsorted(keys, size << 44 | rank, "right") - 1
            found = [slots[at, 2] + rank - slots[at, 1], slots[at, 3]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], *[pa.array(x, pa.int64()) for x in found]],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, target)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(docs: DataFrame, tokens: int = 2048) -> DataFrame:
    """All documents, each with the id 0 at its end, in sequences of `tokens` tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(stored(cut(docs, path, 0, tokens)), Capacity(tokens))
