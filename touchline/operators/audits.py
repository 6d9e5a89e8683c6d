"""Leakage audits of feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leakage_audit(features: DataFrame, source_ts: str = "max_src_ts") -> DataFrame:
    """Feature rows that rest on a source row at or after their kick-off."""
    return features.filter(F.col(source_ts) >= F.col("kickoff"))


def moved_features(before: DataFrame, after: DataFrame, until: object) -> DataFrame:
    """Feature rows up to `until` that changed when only later source rows were changed."""
    return before.filter(F.col("kickoff") <= F.lit(until)).exceptAll(
        after.filter(F.col("kickoff") <= F.lit(until))
    )
