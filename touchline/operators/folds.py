"""Season folds. Folds are literals, so expanding them needs no join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def test_seasons(m: DataFrame, n_folds: int = 5) -> list[int]:
    """The last `n_folds` seasons (at most `n_folds` numbers reach the driver)."""
    latest = m.select("season").distinct().orderBy(F.desc("season")).limit(n_folds)
    return sorted(r["season"] for r in latest.collect())


def expand_folds(df: DataFrame, folds: Sequence[int]) -> DataFrame:
    """One row per fold that uses the row: season < fold trains, season = fold tests."""
    every = F.array(*[F.lit(int(f)) for f in folds])
    usable = F.filter(every, lambda f: f >= F.col("season"))
    return (
        df.filter(F.col("season") <= max(folds))
        .withColumn("fold", F.explode(usable))
        .withColumn("role", F.when(F.col("season") < F.col("fold"), "train").otherwise("test"))
    )


def walk_forward(m: DataFrame, n_folds: int = 5) -> DataFrame:
    return expand_folds(m, test_seasons(m, n_folds))


def split_audit(folds: DataFrame) -> DataFrame:
    """Per fold the season bounds of both roles; `ok` if all training is earlier."""
    train, test = F.col("role") == "train", F.col("role") == "test"

    def count(c: Column) -> Column:
        return F.sum(c.cast("long"))

    return (
        folds.groupBy("fold")
        .agg(
            count(train).alias("n_train"),
            count(test).alias("n_test"),
            F.max(F.when(train, F.col("season"))).alias("train_last"),
            F.min(F.when(test, F.col("season"))).alias("test_first"),
            F.max(F.when(test, F.col("season"))).alias("test_last"),
        )
        .withColumn(
            "ok",
            (F.coalesce("train_last", F.col("fold") - 1) < F.col("test_first"))
            & (F.col("test_first") == F.col("fold"))
            & (F.col("test_last") == F.col("fold")),
        )
    )
