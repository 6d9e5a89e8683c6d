"""Folds, scores, calibration and comparisons."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.operators import folds, scoring
from touchline.operators.forecast.reference import base_rates, market
from touchline.plans import pipeline
from touchline.plans.registry.common import (
    CONTESTS,
    FOLDS,
    N_FOLDS,
    SCOPE,
    SCORING_STACK,
    rounded,
    scope,
    scored_pair,
)
from touchline.session import shared_dir
from touchline.sources.derived import contests, ratings

IDS = ["model", "fold", "match_id"]


def walk_forward(spark, sf_dir):
    return folds.walk_forward(scope(spark, sf_dir), N_FOLDS).select("match_id", "season", "fold", "role")


def split_audit(spark, sf_dir):
    return folds.split_audit(folds.walk_forward(scope(spark, sf_dir), N_FOLDS))


def _pred(spark, sf_dir):
    m = scope(spark, sf_dir)
    seasons = folds.test_seasons(m, N_FOLDS)
    return m, market(m, seasons).unionByName(base_rates(m, seasons))


def common_sample(spark, sf_dir):
    return rounded(scoring.common_sample(_pred(spark, sf_dir)[1]).select(*IDS, "p_h", "p_d", "p_a"))


def score_rows(spark, sf_dir):
    return rounded(
        scored_pair(spark, sf_dir).select(*IDS, "outcome", "log_loss", "rps", "brier", "hit")
    )


def predictions(spark, sf_dir):
    m, pred = _pred(spark, sf_dir)
    return rounded(scoring.predictions(pred, m, season=1999, league=2))


def pipeline_metrics(spark, sf_dir):
    """The report of the whole chain of stages, for the two models that SQL can express."""
    m = contests(spark, sf_dir)
    raw = m.withColumns({"_malformed": F.lit(None).cast("string"), "source_file": F.lit("contests")})
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    return rounded(
        pipeline.run(raw, ratings(m), folder, range(5), n_folds=N_FOLDS, models=("market", "base_rate"))
    )


def _scored(fn):
    return lambda spark, sf_dir: rounded(fn(scored_pair(spark, sf_dir)))


QUERIES = {
    "walk_forward": walk_forward,
    "pipeline_metrics": pipeline_metrics,
    "split_audit": split_audit,
    "common_sample": common_sample,
    "score_rows": score_rows,
    "predictions": predictions,
    "metrics_by_league": _scored(lambda s: scoring.metrics(s, by=["model", "league"])),
    "metric_table": _scored(scoring.metric_table),
    "metric_by_season": _scored(scoring.metric_by_season),
    "calibration": _scored(scoring.calibration),
    "baseline_gap": _scored(lambda s: scoring.baseline_gap(s, "market")),
}

_S = f"WITH {SCORING_STACK}"
_F = f"WITH {CONTESTS},{SCOPE},{FOLDS}"
_MEANS = """count(*) AS n, round(avg(log_loss), 6) AS log_loss, round(avg(rps), 6) AS rps,
  round(avg(brier), 6) AS brier, round(avg(hit), 6) AS accuracy"""

ORACLE = {
    "walk_forward": f"""{_F} SELECT match_id, season, fold, CASE WHEN season < fold THEN 'train' ELSE 'test' END AS role
      FROM scope JOIN folds ON season <= fold""",
    "split_audit": f"""{_F}, x AS (SELECT fold, season FROM scope JOIN folds ON season <= fold)
      SELECT fold, count(*) FILTER (season < fold) AS n_train, count(*) FILTER (season = fold) AS n_test,
        max(season) FILTER (season < fold) AS train_last, min(season) FILTER (season >= fold) AS test_first,
        max(season) FILTER (season >= fold) AS test_last,
        max(season) FILTER (season < fold) < min(season) FILTER (season >= fold) AS ok
      FROM x GROUP BY fold""",
    "common_sample": f"""{_S}, priced AS (SELECT * FROM pred WHERE p_h IS NOT NULL)
      SELECT model, fold, match_id, round(p_h, 6) AS p_h, round(p_d, 6) AS p_d, round(p_a, 6) AS p_a FROM priced
      WHERE match_id IN (SELECT match_id FROM priced GROUP BY match_id HAVING count(DISTINCT model) = 2)""",
    "score_rows": f"""{_S} SELECT model, fold, match_id, outcome, round(log_loss, 6) AS log_loss, round(rps, 6) AS rps,
      round(brier, 6) AS brier, CAST(hit AS double) AS hit FROM scored""",
    "predictions": f"""{_S} SELECT model, fold, match_id, season, league, round(p_h, 6) AS p_h, round(p_d, 6) AS p_d,
      round(p_a, 6) AS p_a, outcome, predicted FROM scored WHERE season = 1999 AND league = 2""",
    "metrics_by_league": f"{_S} SELECT model, league, {_MEANS} FROM scored GROUP BY model, league",
    "metric_table": f"{_S} SELECT model, {_MEANS} FROM scored GROUP BY model",
    "metric_by_season": f"""{_S} SELECT model, season, count(*) AS n, round(avg(rps), 6) AS rps
      FROM scored GROUP BY model, season""",
    "calibration": f"""{_S}, long AS (
        SELECT model, 'H' AS class, p_h AS p, (outcome = 'H')::int AS hit FROM scored
        UNION ALL SELECT model, 'D', p_d, (outcome = 'D')::int FROM scored
        UNION ALL SELECT model, 'A', p_a, (outcome = 'A')::int FROM scored),
      both_ AS (SELECT * FROM long UNION ALL SELECT model, 'all', p, hit FROM long)
      SELECT model, class, CAST(least(floor(p * 10), 9) AS int) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p,
        round(avg(hit), 6) AS hit_rate FROM both_ GROUP BY ALL""",
    "baseline_gap": f"""{_S}, d AS (
        SELECT b.model, b.rps - m.rps AS rps, b.log_loss - m.log_loss AS log_loss, b.brier - m.brier AS brier
        FROM scored b JOIN scored m USING (match_id) WHERE b.model <> 'market' AND m.model = 'market')
      SELECT model, 'market' AS baseline, count(*) AS n, round(avg(rps), 6) AS rps_gap, round(avg(log_loss), 6) AS log_loss_gap,
        round(avg(brier), 6) AS brier_gap, round(stddev_samp(rps) / sqrt(count(*)), 6) AS rps_se,
        round(stddev_samp(log_loss) / sqrt(count(*)), 6) AS log_loss_se, round(stddev_samp(brier) / sqrt(count(*)), 6) AS brier_se
      FROM d GROUP BY model""",
}

_KEPT = SCOPE.replace("scope AS", "chosen AS") + """,
scope AS (SELECT * EXCLUDE (first_id) FROM (SELECT *, min(match_id) OVER (PARTITION BY league, season, home_team, away_team) AS first_id FROM chosen)
  WHERE match_id = first_id AND odds_h IS NOT NULL)"""
ORACLE["pipeline_metrics"] = ORACLE["metric_table"].replace(SCOPE, _KEPT)
