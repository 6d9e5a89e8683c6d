"""Stage tables and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ("league", "season")) -> None:
    """Hand a table to the next stage; only the partitions in `df` are replaced.

    Rows are gathered by partition value; adaptive execution splits a value that holds
    too many rows for one task and joins small ones.
    """
    (
        df.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """An aggregated table as one file."""
    df.repartition(1).write.mode("overwrite").format(fmt).save(path)
