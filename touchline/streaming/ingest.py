"""Resumable ingest: a file that was read once is not read again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from touchline.sources.matches import MALFORMED, raw_schema, tidy


def match_stream(
    spark: SparkSession, src: str, columns: Sequence[str], colmap: Mapping[str, str],
    files_per_batch: int = 1000,
) -> DataFrame:
    raw = (
        spark.readStream.schema(raw_schema(columns, colmap))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(src)
    )
    return tidy(raw, colmap)


def ingest_incremental(
    spark: SparkSession, src: str, dst: str, checkpoint: str,
    columns: Sequence[str], colmap: Mapping[str, str],
) -> None:
    """Read what is new under `src`, append it to `dst`, stop.

    The checkpoint holds the list of files already read and the sink's commit
    log, so a run that died continues at its last batch and a repeated run adds
    nothing.
    """
    query = (
        match_stream(spark, src, columns, colmap)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", dst)
        .partitionBy("league", "season")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
