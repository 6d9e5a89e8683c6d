"""Data-quality report of a match table, and the exclusion ledger."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.skew import checked_broadcast

FIXTURE = ["league", "season", "home_team", "away_team"]


def dq_counts(m: DataFrame) -> DataFrame:
    return m.groupBy("league", "season").agg(F.count("*").alias("n"))


def dq_range(m: DataFrame) -> DataFrame:
    return m.agg(
        F.min("kickoff").alias("first_kickoff"),
        F.max("kickoff").alias("last_kickoff"),
        F.count("*").alias("n"),
    )


def dq_missing(m: DataFrame) -> DataFrame:
    """Missing values per column, in one pass."""
    counts = m.agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in m.columns],
    )
    return counts.unpivot(["n"], list(m.columns), "column_name", "n_missing").select(
        "column_name", "n_missing", "n"
    )


def dq_duplicates(m: DataFrame) -> DataFrame:
    """Fixtures that occur more than once: same league, season, home and away team."""
    return (
        m.groupBy(*FIXTURE)
        .agg(F.count("*").alias("n"), F.min("match_id").alias("first_match_id"))
        .filter(F.col("n") > 1)
    )


def dq_season_size(m: DataFrame) -> DataFrame:
    """Seasons whose match count is not that of a full double round, n = t(t - 1)."""
    per_team = (
        m.select(
            "league", "season",
            F.inline(
                F.array(
                    F.struct(F.col("home_team").alias("team"), F.lit(1).alias("_home")),
                    F.struct(F.col("away_team").alias("team"), F.lit(0).alias("_home")),
                )
            ),
        )
        .groupBy("league", "season", "team")
        .agg(F.sum("_home").alias("_n"))
    )
    return (
        per_team.groupBy("league", "season")
        .agg(F.sum("_n").alias("n"), F.count("*").alias("teams"))
        .withColumn("expected", F.col("teams") * (F.col("teams") - 1))
        .filter(F.col("n") != F.col("expected"))
    )


def flag_repeats(m: DataFrame, name: str = "is_repeat") -> DataFrame:
    """Mark every copy of a fixture but the one with the lowest match_id.

    Only the repeated fixtures are joined back, so a fixture that was copied
    very often is not gathered in one task while that table is broadcast.
    """
    repeated = dq_duplicates(m).select(*[F.col(c).alias(f"_f_{c}") for c in FIXTURE], "first_match_id")
    same = None  # a missing value equals a missing one, as in the count of duplicates
    for c in FIXTURE:
        one = F.col(c).eqNullSafe(F.col(f"_f_{c}"))
        same = one if same is None else same & one
    return (
        m.join(checked_broadcast(repeated), same, "left")
        .withColumn(name, F.coalesce(F.col("match_id") > F.col("first_match_id"), F.lit(False)))
        .select(*m.columns, name)
    )


Rules = Mapping[str, tuple[Column, str]]


def default_rules() -> Rules:
    """Rule name -> (condition that excludes, reason)."""
    return {
        "no_result": (F.col("home_goals").isNull() | F.col("away_goals").isNull(), "result is missing"),
        "no_odds": (
            F.col("odds_h").isNull() | F.col("odds_d").isNull() | F.col("odds_a").isNull(),
            "a closing odd is missing",
        ),
        "repeat": (F.col("is_repeat"), "fixture already listed in this season"),
    }


def input_rules() -> Rules:
    """Rules for rows as they come from the files, marked by `flag_repeats` and `mark_scope`."""
    unpriced = (F.col("odds_h") <= 1) | (F.col("odds_d") <= 1) | (F.col("odds_a") <= 1)
    return {
        "malformed": (F.col("_malformed").isNotNull(), "the line could not be read as its columns"),
        "out_of_scope": (~F.col("in_scope"), "league or season is not part of the study"),
        "unpriced": (unpriced, "a closing odd is no price"),
        **default_rules(),
    }


def apply_exclusions(m: DataFrame, rules: Rules, ids: Sequence[str] = ("match_id",)) -> tuple[DataFrame, DataFrame]:
    """(kept, ledger). A row is kept if no rule fires; the ledger lists each rule that did,
    with the columns `ids` that name the row."""
    fired = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("rule"),
                    F.lit(reason).alias("reason"),
                    F.coalesce(cond, F.lit(False)).alias("_fires"),
                )
                for name, (cond, reason) in rules.items()
            ]
        ),
        lambda r: r["_fires"],
    )
    judged = m.withColumn("_fired", fired)
    kept = judged.filter(F.size("_fired") == 0).drop("_fired")
    ledger = judged.select(*ids, F.inline("_fired")).drop("_fires")
    return kept, ledger
