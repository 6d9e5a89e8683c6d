"""Predictions against results: proper scores, calibration, comparisons.

Prediction frames are long by model: model, fold, match_id, season, league,
p_h, p_d, p_a. An unpriced match has null probabilities and does not count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions import outcomes as fo

PREDICTION = ["model", "fold", "match_id", "season", "league", "p_h", "p_d", "p_a"]
SCORES = ("log_loss", "rps", "brier", "hit")
N_BINS = 10


def score_input(pred: DataFrame, m: DataFrame) -> DataFrame:
    """Predictions with the outcome of their match and the scores of each row."""
    actual = m.select("match_id", fo.outcome("home_goals", "away_goals").alias("outcome"))
    return (
        pred.filter(F.col("p_h").isNotNull())
        .join(actual.filter(F.col("outcome").isNotNull()), "match_id")
        .withColumns(
            {
                "log_loss": fo.log_loss("outcome"),
                "rps": fo.rps("outcome"),
                "brier": fo.brier("outcome"),
                "hit": (fo.favourite() == F.col("outcome")).cast("double"),
            }
        )
    )


def predictions(
    pred: DataFrame, m: DataFrame, season: int | None = None, league: int | None = None
) -> DataFrame:
    """Predicted probabilities and the actual outcome, by season and league.

    Both sides are filtered on the same columns, so a partitioned store is
    pruned on both.
    """
    for column, value in (("season", season), ("league", league)):
        if value is not None:
            pred = pred.filter(F.col(column) == value)
            m = m.filter(F.col(column) == value)
    scored = score_input(pred, m)
    return scored.select(*PREDICTION, "outcome", fo.favourite().alias("predicted"))


def metrics(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean scores and the number of matches they were computed over."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("log_loss").alias("log_loss"),
        F.avg("rps").alias("rps"),
        F.avg("brier").alias("brier"),
        F.avg("hit").alias("accuracy"),
    )


def metric_table(scored: DataFrame) -> DataFrame:
    """Models as rows, metrics as columns, best ranked probability score first."""
    return metrics(scored).orderBy("rps", "model")


def metric_by_season(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model", "season").agg(
        F.count("*").alias("n"), F.avg("rps").alias("rps")
    )


def calibration(scored: DataFrame, bins: int = N_BINS) -> DataFrame:
    """Reliability per model: per class, and pooled over the classes as `all`."""
    classes = F.array(
        *[
            F.struct(
                F.lit(o).alias("class"),
                F.col(p).alias("p"),
                (F.col("outcome") == o).cast("double").alias("hit"),
            )
            for o, p in zip(fo.OUTCOMES, ("p_h", "p_d", "p_a"), strict=True)
        ]
    )
    per_class = (
        scored.select("model", F.inline(classes))
        .withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
        .groupBy("model", "class", "bin")
        .agg(F.count("*").alias("n"), F.sum("p").alias("_p"), F.sum("hit").alias("_hit"))
    )
    # The pooled curve is rolled up from the small per-class table.
    both = per_class.withColumn("class", F.explode(F.array(F.col("class"), F.lit("all"))))
    return (
        both.groupBy("model", "class", "bin")
        .agg(F.sum("n").alias("n"), F.sum("_p").alias("_p"), F.sum("_hit").alias("_hit"))
        .select(
            "model", "class", "bin", "n",
            (F.col("_p") / F.col("n")).alias("mean_p"),
            (F.col("_hit") / F.col("n")).alias("hit_rate"),
        )
    )


def common_sample(pred: DataFrame, n_models: int | None = None) -> DataFrame:
    """Rows of the matches that every model has priced (models are counted if not told)."""
    priced = pred.filter(F.col("p_h").isNotNull())
    if n_models is None:
        n_models = priced.select("model").distinct().count()
    seen = F.size(F.collect_set("model").over(W.partitionBy("match_id")))
    return priced.withColumn("_models", seen).filter(F.col("_models") == n_models).drop("_models")


def baseline_gap(scored: DataFrame, baseline: str, n_models: int | None = None) -> DataFrame:
    """Mean paired difference to a baseline on the common sample, with its standard error.

    Negative means better than the baseline.
    """
    scores = ("rps", "log_loss", "brier")
    per_match = W.partitionBy("match_id")
    rows = common_sample(scored, n_models).withColumns(
        {
            f"_d_{s}": F.col(s)
            - F.max(F.when(F.col("model") == baseline, F.col(s))).over(per_match)
            for s in scores
        }
    )
    return (
        rows.filter(F.col("model") != baseline)
        .groupBy("model")
        .agg(
            F.lit(baseline).alias("baseline"),
            F.count("*").alias("n"),
            *[F.avg(f"_d_{s}").alias(f"{s}_gap") for s in scores],
            *[
                (F.stddev_samp(f"_d_{s}") / F.sqrt(F.count("*"))).alias(f"{s}_se")
                for s in scores
            ],
        )
    )


def ablation(scored_without: DataFrame, scored_with: DataFrame) -> DataFrame:
    """Does an addition improve the ranked probability score? `keep` says so."""
    keep = ["match_id", "p_h", "rps", "log_loss", "brier"]
    scored_without, scored_with = scored_without.select(*keep), scored_with.select(*keep)
    a = scored_without.withColumn("model", F.lit("without"))
    b = scored_with.withColumn("model", F.lit("with"))
    gap = baseline_gap(a.unionByName(b), "without", n_models=2)
    return gap.withColumn("keep", F.col("rps_gap") < 0)
