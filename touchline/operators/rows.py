"""Row-level match operators: labels, team rows, market probabilities, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import outcomes as fo


def with_outcome(m: DataFrame) -> DataFrame:
    return m.withColumns(
        {
            "outcome": fo.outcome("home_goals", "away_goals"),
            "points_h": fo.points("home_goals", "away_goals"),
            "points_a": fo.points("away_goals", "home_goals"),
        }
    )


def team_rows(m: DataFrame) -> DataFrame:
    """Two rows per match, one for each side, in one pass over the matches."""

    def side(name: str, team: str, other: str, gf: str, ga: str) -> Column:
        return F.struct(
            F.col(team).alias("team"),
            F.col(other).alias("opponent"),
            F.lit(name).alias("side"),
            F.col(gf).alias("gf"),
            F.col(ga).alias("ga"),
            fo.points(gf, ga).alias("points"),
        )

    home = side("H", "home_team", "away_team", "home_goals", "away_goals")
    away = side("A", "away_team", "home_team", "away_goals", "home_goals")
    return m.select("match_id", "kickoff", "season", "league", F.inline(F.array(home, away)))


def devig(m: DataFrame) -> DataFrame:
    return m.withColumns(fo.devig("odds_h", "odds_d", "odds_a"))


def decay_weight(m: DataFrame, cutoff: Column | str, xi: float) -> DataFrame:
    when = F.lit(cutoff).cast("timestamp_ntz") if isinstance(cutoff, str) else cutoff
    return m.withColumn("weight", fo.decay("kickoff", when, xi))
