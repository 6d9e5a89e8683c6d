"""Shared pieces of the registered queries and of their checking SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.folds import test_seasons
from touchline.operators.forecast.reference import base_rates, market
from touchline.operators.scoring import score_input
from touchline.sources.derived import contests
from touchline.sources.matches import select_scope

N_FOLDS = 5


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order does not show; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def scaled_round(value: Column, digits: int) -> Column:
    """The double rounded half away from zero as SQL does it, on the scaled value and not on
    decimals, which takes a small part of the time. What has no such digits stays as it is."""
    scale = F.lit(float(10**digits))
    steps = F.abs(value) * scale
    near = F.signum(value) * F.floor(steps + 0.5) / scale
    return F.when(steps < float(1 << 52), near).otherwise(value) + F.lit(0.0)


def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leagues, last 12 completed seasons."""
    return select_scope(contests(spark, sf_dir), leagues=range(5), n=12)


def scored_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market and base rates, scored over the last seasons."""
    m = scope(spark, sf_dir)
    folds = test_seasons(m, N_FOLDS)
    pred = market(m, folds).unionByName(base_rates(m, folds))
    return score_input(pred, m)


# ---- checking SQL -----------------------------------------------------------

CONTESTS = """
a AS (
  SELECT o_orderkey AS match_id, o_orderdate AS kickoff, CAST(year(o_orderdate) AS int) AS season,
         o_orderkey % 5 AS league, o_custkey % 18 AS hs,
         (o_custkey % 18 + 1 + CAST(floor(o_orderkey / 5) AS bigint) % 17) % 18 AS aws,
         CAST(round(o_totalprice * 100) AS bigint) AS c
  FROM orders),
contests AS (
  SELECT match_id, kickoff, season, league,
       league * 100 + hs  + 2 * (season - 1995) AS home_team,
       league * 100 + aws + 2 * (season - 1995) AS away_team,
       (c % 7) % 4 AS home_goals,
       (CAST(floor(c / 7) AS bigint) % 5) % 3 AS away_goals,
       CASE WHEN c % 23 = 0 THEN NULL ELSE CAST(120 + CAST(floor(c / 11) AS bigint) % 200 AS double) / 100 END AS odds_h,
       CASE WHEN c % 23 = 0 THEN NULL ELSE CAST(250 + CAST(floor(c / 13) AS bigint) % 130 AS double) / 100 END AS odds_d,
       CASE WHEN c % 23 = 0 THEN NULL ELSE CAST(140 + CAST(floor(c / 17) AS bigint) % 300 AS double) / 100 END AS odds_a
  FROM a)"""

RATINGS = """
ratings AS (
  SELECT DISTINCT team, date_trunc('month', kickoff) AS valid_from,
         CAST(1400 + (team * 37 + month(kickoff) * 11 + year(kickoff)) % 200 AS double) AS rating
  FROM (SELECT home_team AS team, kickoff FROM contests
        UNION ALL SELECT away_team, kickoff FROM contests) x)"""

TEAM_ROWS = """
team_rows AS (
  SELECT match_id, kickoff, season, league, home_team AS team, away_team AS opponent, 'H' AS side,
         home_goals AS gf, away_goals AS ga,
         CAST(CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS bigint) AS points
  FROM contests
  UNION ALL
  SELECT match_id, kickoff, season, league, away_team, home_team, 'A', away_goals, home_goals,
         CAST(CASE WHEN away_goals > home_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS bigint)
  FROM contests)"""

SCOPE = """
scope AS (
  SELECT c.* FROM contests c JOIN (
    SELECT league, season, dense_rank() OVER (PARTITION BY league ORDER BY season DESC) AS age
    FROM (SELECT DISTINCT league, season, max(season) OVER (PARTITION BY league) AS latest FROM contests)
    WHERE season < latest) s USING (league, season)
  WHERE s.age <= 12 AND c.league BETWEEN 0 AND 4)"""

FOLDS = f"""
folds AS (SELECT DISTINCT season AS fold FROM scope ORDER BY fold DESC LIMIT {N_FOLDS})"""

OUTCOME = "CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' ELSE 'A' END"

MARKET = """
market AS (
  SELECT 'market' AS model, season AS fold, match_id, season, league,
         CASE WHEN ok THEN (1 / odds_h) / s END AS p_h,
         CASE WHEN ok THEN (1 / odds_d) / s END AS p_d,
         CASE WHEN ok THEN (1 / odds_a) / s END AS p_a
  FROM (SELECT *, odds_h > 1 AND odds_d > 1 AND odds_a > 1 AS ok,
               1 / odds_h + 1 / odds_d + 1 / odds_a AS s FROM scope)
  WHERE season IN (SELECT fold FROM folds))"""

BASE_RATE = f"""
shares AS (
  SELECT fold, avg(CASE WHEN y = 'H' THEN 1.0 ELSE 0.0 END) AS p_h,
         avg(CASE WHEN y = 'D' THEN 1.0 ELSE 0.0 END) AS p_d,
         avg(CASE WHEN y = 'A' THEN 1.0 ELSE 0.0 END) AS p_a
  FROM (SELECT fold, {OUTCOME} AS y FROM folds JOIN scope ON season < fold) GROUP BY fold),
base_rate AS (
  SELECT 'base_rate' AS model, season AS fold, match_id, season, league, p_h, p_d, p_a
  FROM scope JOIN shares ON season = fold)"""

SCORED = f"""
pred AS (SELECT * FROM market UNION ALL SELECT * FROM base_rate),
scored AS (
  SELECT p.*, y.outcome,
    -ln(greatest(CASE outcome WHEN 'H' THEN p_h WHEN 'D' THEN p_d ELSE p_a END, 1e-15)) AS log_loss,
    (pow(p_h - (outcome = 'H')::int, 2) + pow(p_h + p_d - (outcome <> 'A')::int, 2)) / 2 AS rps,
    pow(p_h - (outcome = 'H')::int, 2) + pow(p_d - (outcome = 'D')::int, 2)
      + pow(p_a - (outcome = 'A')::int, 2) AS brier,
    CASE WHEN p_h >= p_d AND p_h >= p_a THEN 'H' WHEN p_d >= p_a THEN 'D' ELSE 'A' END AS predicted,
    (CASE WHEN p_h >= p_d AND p_h >= p_a THEN 'H' WHEN p_d >= p_a THEN 'D' ELSE 'A' END = outcome)::int AS hit
  FROM pred p JOIN (SELECT match_id, {OUTCOME} AS outcome FROM scope) y USING (match_id)
  WHERE p_h IS NOT NULL)"""

SCORING_STACK = ",".join([CONTESTS, SCOPE, FOLDS, MARKET, BASE_RATE, SCORED])
