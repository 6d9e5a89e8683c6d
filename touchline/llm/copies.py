"""Texts that occur more than once, found by hashes before any text is moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import stored
from touchline.operators.skew import checked_broadcast

PART_ROWS = 2000  # copies of one hash that meet in one task


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def repeated(hashed: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that several rows hold, and n_parts: over how many tasks their rows are spread.

    Counted before the shuffle, so a group of copies is one row per task.
    """
    counts = hashed.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    return stored(counts.select(*keys, F.ceil(F.col("_n") / F.lit(PART_ROWS)).cast("int").alias("n_parts")))


def among(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The rows whose keys are in `found` (or, with left_anti, are not). The list is
    broadcast behind a check of its size; beyond it the rows are shuffled by hash."""
    return rows.join(checked_broadcast(found), keys, how)
