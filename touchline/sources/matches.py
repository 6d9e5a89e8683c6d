"""Reading the tidy match table and the rating feed; choosing the scope."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.skew import checked_broadcast

MATCH_SCHEMA = T.StructType(
    [
        T.StructField("match_id", T.LongType()),
        T.StructField("kickoff", T.TimestampNTZType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("league", T.LongType()),
        T.StructField("home_team", T.LongType()),
        T.StructField("away_team", T.LongType()),
        T.StructField("home_goals", T.LongType()),
        T.StructField("away_goals", T.LongType()),
        T.StructField("odds_h", T.DoubleType()),
        T.StructField("odds_d", T.DoubleType()),
        T.StructField("odds_a", T.DoubleType()),
    ]
)
RATING_SCHEMA = T.StructType(
    [
        T.StructField("team", T.LongType()),
        T.StructField("valid_from", T.TimestampNTZType()),
        T.StructField("rating", T.DoubleType()),
    ]
)
MALFORMED = "_malformed"


def raw_schema(
    columns: Sequence[str], colmap: Mapping[str, str], schema: T.StructType = MATCH_SCHEMA
) -> T.StructType:
    """The schema of a raw file: its own names and order, our types.

    `colmap` maps our names to the names in the file. Columns of the file that
    are not mapped are read as strings and dropped later.
    """
    ours = {theirs: schema[name].dataType for name, theirs in colmap.items()}
    fields = [T.StructField(c, ours.get(c, T.StringType())) for c in columns]
    return T.StructType([*fields, T.StructField(MALFORMED, T.StringType())])


def tidy(raw: DataFrame, colmap: Mapping[str, str], schema: T.StructType = MATCH_SCHEMA) -> DataFrame:
    """Rename to our names; columns the file lacks become typed nulls."""
    present = set(raw.columns)
    columns = [
        (F.col(colmap[f.name]) if colmap.get(f.name) in present else F.lit(None))
        .cast(f.dataType)
        .alias(f.name)
        for f in schema.fields
    ]
    extra = [MALFORMED] if MALFORMED in present else []
    return raw.select(*columns, *extra, F.col("_metadata.file_path").alias("source_file"))


def read_matches(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], colmap: Mapping[str, str]
) -> DataFrame:
    """Raw result and odds files as the tidy match table.

    Malformed lines are kept with `_malformed` set, so that the exclusion
    ledger can name them.
    """
    raw = (
        spark.read.schema(raw_schema(columns, colmap))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .csv(path)
    )
    return tidy(raw, colmap)


def read_ratings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(RATING_SCHEMA)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def select_scope(
    m: DataFrame,
    leagues: Sequence[int] | None = None,
    n: int = 12,
    completed: Sequence[tuple[int, int]] = (),
) -> DataFrame:
    """Rows of the chosen leagues in their last `n` completed seasons.

    A season is complete when a later one has started in the same league, or
    when (league, season) is listed in `completed`.
    """
    kept = _chosen_seasons(m, leagues, n, completed)
    return m.join(kept, ["league", "season"], "left_semi").select(*m.columns)


def mark_scope(
    m: DataFrame,
    leagues: Sequence[int] | None = None,
    n: int = 12,
    completed: Sequence[tuple[int, int]] = (),
) -> DataFrame:
    """All rows with `in_scope`, which `select_scope` would have kept."""
    kept = _chosen_seasons(m, leagues, n, completed).withColumn("_in", F.lit(True))
    marked = m.join(kept, ["league", "season"], "left")
    return marked.select(*m.columns, F.coalesce("_in", F.lit(False)).alias("in_scope"))


def _chosen_seasons(
    m: DataFrame, leagues: Sequence[int] | None, n: int, completed: Sequence[tuple[int, int]]
) -> DataFrame:
    if leagues is not None:
        m = m.filter(F.col("league").isin(list(leagues)))
    seasons = m.select("league", "season").distinct()
    done = F.col("season") < F.max("season").over(W.partitionBy("league"))
    for league, season in completed:
        done = done | ((F.col("league") == league) & (F.col("season") == season))
    kept = (
        seasons.withColumn("_done", done)
        .filter("_done")
        .withColumn("_age", F.dense_rank().over(W.partitionBy("league").orderBy(F.desc("season"))))
        .filter(F.col("_age") <= n)
        .select("league", "season")
    )
    # With a league list there are at most leagues x n rows to send.
    return F.broadcast(kept) if leagues is not None else checked_broadcast(kept)


def union_inputs(*parts: DataFrame) -> DataFrame:
    """Inputs of several leagues, or outputs of several models, as one frame."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first
