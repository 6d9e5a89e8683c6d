"""Scope, row-level operators, data quality, stages and ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.functions.outcomes import OUTCOMES
from touchline.operators import quality, rows
from touchline.operators.imbalance import class_weight
from touchline.plans.registry.common import CONTESTS, OUTCOME, SCOPE, TEAM_ROWS, rounded, scope
from touchline.session import shared_dir
from touchline.sources.derived import contests, ratings
from touchline.sources.matches import read_matches, read_ratings, select_scope, union_inputs
from touchline.sources.stages import read_stage, write_report, write_stage
from touchline.streaming.ingest import ingest_incremental

MATCH_COLUMNS = ["match_id", "season", "league"]
CSV_COLUMNS = {
    "match_id": "Id", "kickoff": "Date", "season": "Season", "league": "Div", "home_team": "Home",
    "away_team": "Away", "home_goals": "HG", "away_goals": "AG", "odds_h": "OH", "odds_d": "OD",
    "odds_a": "OA",
}


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _csv_inputs(spark, sf_dir: str, folder: str) -> None:
    """The contests as raw files with foreign column names, one folder per league."""
    raw = contests(spark, sf_dir).select(
        *[F.col(ours).alias(theirs) for ours, theirs in CSV_COLUMNS.items()],
        F.col("league").alias("part"),
    )
    raw.write.partitionBy("part").option("header", True).csv(folder)


def read_raw(spark, sf_dir):
    folder = _folder(spark, "raw")
    _csv_inputs(spark, sf_dir, folder)
    m = read_matches(spark, folder, list(CSV_COLUMNS.values()), CSV_COLUMNS)
    return m.drop("source_file", "_malformed")


def incremental(spark, sf_dir):
    """Two runs over the same input: the second one reads nothing again."""
    source, target, state = (_folder(spark, n) for n in ("raw", "matches", "state"))
    _csv_inputs(spark, sf_dir, source)
    for _ in range(2):
        ingest_incremental(
            spark, f"{source}/part=*", target, state, list(CSV_COLUMNS.values()), CSV_COLUMNS
        )
    return (
        read_stage(spark, target).groupBy("league", "season").agg(F.count("*").alias("n"))
        .select(F.col("league").cast("long").alias("league"), F.col("season").cast("int").alias("season"), "n")
    )


def rating_feed(spark, sf_dir):
    folder = _folder(spark, "ratings")
    ratings(contests(spark, sf_dir)).write.parquet(folder)
    return read_ratings(spark, folder)


def stage_round_trip(spark, sf_dir):
    folder = _folder(spark, "stage")
    write_stage(contests(spark, sf_dir), folder)
    return read_stage(spark, folder).groupBy("league", "season").agg(
        F.count("*").alias("n"), F.sum("home_goals").alias("home_goals")
    ).select(F.col("league").cast("long").alias("league"), F.col("season").cast("int").alias("season"), "n", "home_goals")


def report_round_trip(spark, sf_dir):
    folder = _folder(spark, "report")
    write_report(quality.dq_missing(contests(spark, sf_dir)), folder)
    return spark.read.schema("column_name string, n_missing long, n long").json(folder)


def scoped(spark, sf_dir):
    return scope(spark, sf_dir)


def outcome_labels(spark, sf_dir):
    m = rows.with_outcome(contests(spark, sf_dir))
    return m.select(*MATCH_COLUMNS, "outcome", "points_h", "points_a")


def team_rows(spark, sf_dir):
    return rows.team_rows(contests(spark, sf_dir))


def devig(spark, sf_dir):
    m = rows.devig(contests(spark, sf_dir))
    return rounded(m.select(*MATCH_COLUMNS, "p_h", "p_d", "p_a"))


def decay_weight(spark, sf_dir):
    m = rows.decay_weight(contests(spark, sf_dir), "2001-01-01 00:00:00", 0.0019)
    return rounded(m.select(*MATCH_COLUMNS, "weight"))


def class_weights(spark, sf_dir):
    m = rows.with_outcome(contests(spark, sf_dir))
    return rounded(class_weight(m, "outcome").select("match_id", "outcome", "class_weight"))


def league_union(spark, sf_dir):
    m = contests(spark, sf_dir)
    parts = [select_scope(m, leagues=[i], n=12) for i in range(5)]
    return union_inputs(*parts).select(*MATCH_COLUMNS, "home_team", "away_team")


def _dq(fn):
    return lambda spark, sf_dir: fn(contests(spark, sf_dir))


def _exclusions(spark, sf_dir):
    m = quality.flag_repeats(contests(spark, sf_dir))
    return quality.apply_exclusions(m, quality.default_rules())


def exclusion_ledger(spark, sf_dir):
    return _exclusions(spark, sf_dir)[1]


def exclusion_kept(spark, sf_dir):
    return _exclusions(spark, sf_dir)[0].select(*MATCH_COLUMNS, "home_team", "away_team")


QUERIES = {
    "read_matches": read_raw,
    "ingest_incremental": incremental,
    "select_scope": scoped,
    "read_ratings": rating_feed,
    "write_stage": stage_round_trip,
    "write_report": report_round_trip,
    "union_leagues": league_union,
    "with_outcome": outcome_labels,
    "team_rows": team_rows,
    "devig": devig,
    "decay_weight": decay_weight,
    "class_weight": class_weights,
    "dq_counts": _dq(quality.dq_counts),
    "dq_range": _dq(quality.dq_range),
    "dq_missing": _dq(quality.dq_missing),
    "dq_duplicates": _dq(quality.dq_duplicates),
    "dq_season_size": _dq(quality.dq_season_size),
    "exclusion_ledger": exclusion_ledger,
    "exclusion_kept": exclusion_kept,
}

_COLS = list(CSV_COLUMNS)
_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(sum(({c} IS NULL)::int) AS bigint) AS n_missing, count(*) AS n FROM contests"
    for c in _COLS
)
_W = f"WITH {CONTESTS}"
_REPEATS = """
flagged AS (SELECT *, match_id > min(match_id) OVER (PARTITION BY league, season, home_team, away_team) AS is_repeat FROM contests),
ledger AS (
  SELECT match_id, 'no_result' AS rule, 'result is missing' AS reason FROM flagged WHERE home_goals IS NULL OR away_goals IS NULL
  UNION ALL SELECT match_id, 'no_odds', 'a closing odd is missing' FROM flagged WHERE odds_h IS NULL OR odds_d IS NULL OR odds_a IS NULL
  UNION ALL SELECT match_id, 'repeat', 'fixture already listed in this season' FROM flagged WHERE is_repeat)"""

ORACLE = {
    "read_matches": f"{_W} SELECT * FROM contests",
    "ingest_incremental": f"{_W} SELECT league, season, count(*) AS n FROM contests GROUP BY ALL",
    "select_scope": f"{_W},{SCOPE} SELECT * FROM scope",
    "read_ratings": f"""{_W},
      x AS (SELECT home_team AS team, kickoff FROM contests UNION ALL SELECT away_team, kickoff FROM contests)
      SELECT DISTINCT team, CAST(date_trunc('month', kickoff) AS timestamp) AS valid_from,
        CAST(1400 + (team * 37 + month(kickoff) * 11 + year(kickoff)) % 200 AS double) AS rating FROM x""",
    "write_stage": f"""{_W} SELECT league, season, count(*) AS n, CAST(sum(home_goals) AS bigint) AS home_goals
      FROM contests GROUP BY ALL""",
    "write_report": f"{_W} {_MISSING}",
    "union_leagues": f"{_W},{SCOPE} SELECT match_id, season, league, home_team, away_team FROM scope",
    "with_outcome": f"""{_W} SELECT match_id, season, league, {OUTCOME} AS outcome,
      CAST(CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS bigint) AS points_h,
      CAST(CASE WHEN home_goals < away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS bigint) AS points_a
      FROM contests""",
    "team_rows": f"{_W},{TEAM_ROWS} SELECT * FROM team_rows",
    "devig": f"""{_W} SELECT match_id, season, league,
      round(CASE WHEN ok THEN (1 / odds_h) / s END, 6) AS p_h, round(CASE WHEN ok THEN (1 / odds_d) / s END, 6) AS p_d,
      round(CASE WHEN ok THEN (1 / odds_a) / s END, 6) AS p_a
      FROM (SELECT *, odds_h > 1 AND odds_d > 1 AND odds_a > 1 AS ok, 1 / odds_h + 1 / odds_d + 1 / odds_a AS s FROM contests)""",
    "decay_weight": f"""{_W} SELECT match_id, season, league,
      CASE WHEN kickoff < TIMESTAMP '2001-01-01' THEN round(exp(-0.0019 * date_diff('day', CAST(kickoff AS date), DATE '2001-01-01')), 6) END AS weight FROM contests""",
    "class_weight": f"""{_W}, y AS (SELECT match_id, {OUTCOME} AS outcome FROM contests),
      k AS (SELECT outcome, (SELECT count(*) FROM y) / (count(*) * {float(len(OUTCOMES))}) AS w FROM y GROUP BY outcome)
      SELECT match_id, outcome, round(w, 6) AS class_weight FROM y JOIN k USING (outcome)""",
    "dq_counts": f"{_W} SELECT league, season, count(*) AS n FROM contests GROUP BY ALL",
    "dq_range": f"{_W} SELECT min(kickoff) AS first_kickoff, max(kickoff) AS last_kickoff, count(*) AS n FROM contests",
    "dq_missing": f"{_W} {_MISSING}",
    "dq_duplicates": f"""{_W} SELECT league, season, home_team, away_team, count(*) AS n, min(match_id) AS first_match_id
      FROM contests GROUP BY ALL HAVING count(*) > 1""",
    "dq_season_size": f"""{_W},
      t AS (SELECT league, season, count(DISTINCT team) AS teams FROM (
        SELECT league, season, home_team AS team FROM contests UNION ALL SELECT league, season, away_team FROM contests) GROUP BY ALL),
      c AS (SELECT league, season, count(*) AS n FROM contests GROUP BY ALL)
      SELECT league, season, n, teams, teams * (teams - 1) AS expected FROM c JOIN t USING (league, season)
      WHERE n <> teams * (teams - 1)""",
    "exclusion_ledger": f"{_W},{_REPEATS} SELECT * FROM ledger",
    "exclusion_kept": f"""{_W},{_REPEATS} SELECT match_id, season, league, home_team, away_team FROM contests
      WHERE match_id NOT IN (SELECT match_id FROM ledger)""",
}
