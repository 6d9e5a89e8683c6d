"""The feature table: one row per match, everything strictly before kick-off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.asof import asof_join
from touchline.operators.form import (
    attach_sides,
    head_to_head,
    matchday,
    promoted_flag,
    rolling_form,
)
from touchline.operators.rows import team_rows
from touchline.operators.skew import checked_broadcast, has_hot_groups, task_parts

SPANS = (5, 10)
KINDS = ("points", "gf", "ga", "gd", "n_used")
SIDE_COLUMNS = [
    "rating",
    *[f"{p}{n}_{k}" for p in ("form", "side") for n in SPANS for k in KINDS],
    "rest",
    "matchday",
    "promoted",
]


def rated_matches(m: DataFrame, ratings: DataFrame) -> DataFrame:
    """Matches with the rating of each side before the match, and the difference."""
    sides = team_rows(m).select("match_id", "kickoff", "team", "side")
    rated = asof_join(sides, ratings, ["team"], "kickoff", "valid_from")
    return attach_sides(m, rated, ["rating", "valid_from"], diffs=["rating"])


def team_features(m: DataFrame, ratings: DataFrame, cold: bool = False, parts: int | None = None) -> DataFrame:
    """Per (match, side). Without a hot team all windows share one shuffle on the team.

    Ratings are attached first, while the rows are still narrow.
    """
    t = asof_join(team_rows(m), ratings, ["team"], "kickoff", "valid_from", parts=parts)
    t = rolling_form(t, SPANS, last_ts="last_played", cold=cold)
    t = rolling_form(t, SPANS, side="own", cold=cold)
    t = matchday(t, cold=cold)
    t = t.withColumn("rest", F.datediff("kickoff", "last_played").cast("long"))
    promoted = checked_broadcast(promoted_flag(m))
    return t.join(promoted, ["league", "season", "team"], "left")


def build_features(m: DataFrame, ratings: DataFrame) -> DataFrame:
    """Features of every match, with `max_src_ts`, the latest source time behind them."""
    # All windows are within a team, so one check of the teams serves them all.
    cold = not has_hot_groups(team_rows(m), ["team"])
    parts = task_parts(2 * m.count())
    feats = team_features(m, ratings, cold, parts)
    h2h = head_to_head(m, 3, last_ts="h2h_last", cold=cold, parts=parts)
    wide = attach_sides(
        h2h, feats, [*SIDE_COLUMNS, "last_played", "valid_from"], diffs=["rating"], parts=parts
    )
    sources = ["last_played_h", "last_played_a", "valid_from_h", "valid_from_a", "h2h_last"]
    return wide.withColumn("max_src_ts", F.greatest(*sources)).drop(*sources)
