"""As-of features, their joins and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import form
from touchline.operators.asof import asof_join, enrich_asof
from touchline.operators.audits import leakage_audit
from touchline.operators.rows import team_rows
from touchline.plans.features import build_features, rated_matches
from touchline.plans.registry.common import CONTESTS, RATINGS, TEAM_ROWS, rounded
from touchline.sources.derived import contests, ratings, table

ROW = ["match_id", "side", "team"]


def _sides(spark, sf_dir):
    return team_rows(contests(spark, sf_dir))


def _form(n, side=None):
    def run(spark, sf_dir):
        prefix = "side" if side == "own" else "form"
        out = form.rolling_form(_sides(spark, sf_dir), n, side=side)
        return out.select(*ROW, *[f"{prefix}{n}_{k}" for k in ("points", "gf", "ga", "gd", "n_used")])

    return run


def rest(spark, sf_dir):
    return form.rest_days(_sides(spark, sf_dir)).select(*ROW, "rest")


def matchday(spark, sf_dir):
    return form.matchday(_sides(spark, sf_dir)).select(*ROW, "matchday")


def h2h(spark, sf_dir):
    return form.head_to_head(contests(spark, sf_dir), 3).select(
        "match_id", "home_team", "away_team", "h2h3_points", "h2h3_gf", "h2h3_ga", "h2h3_n_used"
    )


def promoted(spark, sf_dir):
    return form.promoted_flag(contests(spark, sf_dir))


def asof(spark, sf_dir):
    m = contests(spark, sf_dir)
    sides = team_rows(m).select("match_id", "kickoff", "team", "side")
    return asof_join(sides, ratings(m), ["team"], "kickoff", "valid_from")


def sides_attached(spark, sf_dir):
    m = contests(spark, sf_dir)
    return rounded(
        rated_matches(m, ratings(m)).select(
            "match_id", "home_team", "away_team", "rating_h", "rating_a", "rating_diff"
        )
    )


def enriched(spark, sf_dir):
    """An optional feed, here the last dispatched order line of the match's league."""
    m = contests(spark, sf_dir)
    feed = table(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_orderkey") % 5).alias("league"), F.col("l_shipdate").alias("seen")
    ).agg(F.sum("l_quantity").alias("load"))
    out = enrich_asof(m, feed, ["league"], "seen", "feed_")
    return rounded(out.select("match_id", "league", "feed_seen", "feed_load"))


FEATURE_COLUMNS = [
    "match_id", "rating_diff", "form5_points_h", "form5_points_a", "form10_gd_h", "form10_gd_a",
    "side5_points_h", "side5_points_a", "side10_gf_h", "side10_ga_a", "rest_h", "rest_a",
    "matchday_h", "matchday_a", "promoted_h", "promoted_a", "h2h3_points", "max_src_ts",
]


def feature_table(spark, sf_dir):
    m = contests(spark, sf_dir)
    return rounded(build_features(m, ratings(m)).select(*FEATURE_COLUMNS))


def leakage(spark, sf_dir):
    """No row is the right answer."""
    m = contests(spark, sf_dir)
    return leakage_audit(build_features(m, ratings(m))).select("match_id", "kickoff", "max_src_ts")


def planted(spark, sf_dir):
    """The audit on features with two planted leaks: league 2 uses the rating of the month's
    end, league 3 one of the same instant. It must find just the rows these reach."""
    m = contests(spark, sf_dir)
    month = F.date_trunc("month", "kickoff").cast("timestamp_ntz")
    late = F.when(F.col("league") == 2, month + F.expr("INTERVAL 1 MONTH")).when(F.col("league") == 3, month)
    leaky = build_features(m, ratings(m)).withColumn("max_src_ts", F.greatest("max_src_ts", late))
    return leakage_audit(leaky).select("match_id", "kickoff", "max_src_ts")


QUERIES = {
    "form_last_5": _form(5),
    "form_last_10": _form(10),
    "home_form": _form(5, "H"),
    "away_form": _form(5, "A"),
    "own_side_form": _form(10, "own"),
    "rest_days": rest,
    "matchday": matchday,
    "head_to_head": h2h,
    "promoted_flag": promoted,
    "asof_join": asof,
    "attach_sides": sides_attached,
    "enrich_asof": enriched,
    "build_features": feature_table,
    "leakage_audit": leakage,
    "planted_leaks": planted,
}

_W = f"WITH {CONTESTS},{TEAM_ROWS}"


def _back(name: str, match: str) -> str:
    """Earlier rows of each team row, numbered backwards."""
    return f"""
{name} AS (
  SELECT t.match_id, t.side, e.points, e.gf, e.ga, e.kickoff AS played,
    row_number() OVER (PARTITION BY t.match_id, t.side ORDER BY e.kickoff DESC, e.match_id DESC) AS back
  FROM team_rows t JOIN team_rows e ON e.team = t.team AND e.kickoff < t.kickoff {match})"""


def _sum(column: str, n: int) -> str:
    return f"CAST(sum({column}) FILTER (back <= {n}) AS bigint)"


def _form_sql(n: int, side: str | None = None) -> str:
    match = "" if side is None else "AND e.side = t.side"
    where = f"WHERE t.side = '{side}'" if side in ("H", "A") else ""
    prefix = "side" if side == "own" else "form"
    return f"""{_W},{_back("b", match)}
      SELECT t.match_id, t.side, t.team, {_sum("b.points", n)} AS {prefix}{n}_points, {_sum("b.gf", n)} AS {prefix}{n}_gf,
        {_sum("b.ga", n)} AS {prefix}{n}_ga, {_sum("b.gf - b.ga", n)} AS {prefix}{n}_gd,
        count(b.back) FILTER (back <= {n}) AS {prefix}{n}_n_used
      FROM team_rows t LEFT JOIN b USING (match_id, side) {where} GROUP BY t.match_id, t.side, t.team"""


_ASOF = """
sides_rated AS (
  SELECT t.match_id, t.kickoff, t.team, t.side, r.valid_from, r.rating
  FROM team_rows t ASOF LEFT JOIN ratings r ON t.team = r.team AND t.kickoff > r.valid_from)"""

_H2H = """
meet AS (
  SELECT m.match_id, e.kickoff AS played,
    CASE WHEN e.home_goals = e.away_goals THEN 1
         WHEN (e.home_team = m.home_team) = (e.home_goals > e.away_goals) THEN 3 ELSE 0 END AS pts,
    CASE WHEN e.home_team = m.home_team THEN e.home_goals ELSE e.away_goals END AS gf,
    CASE WHEN e.home_team = m.home_team THEN e.away_goals ELSE e.home_goals END AS ga,
    row_number() OVER (PARTITION BY m.match_id ORDER BY e.kickoff DESC, e.match_id DESC) AS back
  FROM contests m JOIN contests e
    ON least(e.home_team, e.away_team) = least(m.home_team, m.away_team)
   AND greatest(e.home_team, e.away_team) = greatest(m.home_team, m.away_team) AND e.kickoff < m.kickoff)"""

_PROMOTED = """
present AS (SELECT DISTINCT league, season, team FROM team_rows),
promoted AS (
  SELECT n.league, n.season, n.team,
    CASE WHEN (n.league, n.season - 1) IN (SELECT (league, season) FROM present) THEN b.team IS NULL END AS promoted
  FROM present n LEFT JOIN present b ON b.league = n.league AND b.season = n.season - 1 AND b.team = n.team)"""

_MATCHDAY = """
days AS (
  SELECT match_id, side, team,
    CAST(rank() OVER (PARTITION BY league, season, team ORDER BY kickoff) AS bigint) AS matchday FROM team_rows)"""

_FEATURES = f"""
per_side AS (
  SELECT t.match_id, t.side,
    any_value(r.rating) AS rating, any_value(r.valid_from) AS valid_from, any_value(d.matchday) AS matchday,
    any_value(p.promoted) AS promoted, max(b.played) AS last_played,
    any_value(CAST(date_diff('day', CAST(lp.last_at AS date), CAST(t.kickoff AS date)) AS bigint)) AS rest,
    {_sum("b.points", 5)} AS form5_points, {_sum("b.gf - b.ga", 10)} AS form10_gd
  FROM team_rows t LEFT JOIN b USING (match_id, side)
    LEFT JOIN (SELECT match_id, side, max(played) AS last_at FROM b GROUP BY ALL) lp USING (match_id, side)
    JOIN sides_rated r USING (match_id, side) JOIN days d USING (match_id, side)
    JOIN promoted p ON p.league = t.league AND p.season = t.season AND p.team = t.team
  GROUP BY t.match_id, t.side),
own AS (
  SELECT match_id, side, {_sum("points", 5)} AS side5_points, {_sum("gf", 10)} AS side10_gf, {_sum("ga", 10)} AS side10_ga
  FROM o GROUP BY match_id, side),
hh AS (SELECT match_id, {_sum("pts", 3)} AS h2h3_points, max(played) AS h2h_last FROM meet GROUP BY match_id)"""

ORACLE = {
    "form_last_5": _form_sql(5),
    "form_last_10": _form_sql(10),
    "home_form": _form_sql(5, "H"),
    "away_form": _form_sql(5, "A"),
    "own_side_form": _form_sql(10, "own"),
    "rest_days": f"""{_W} SELECT t.match_id, t.side, t.team,
      CAST(date_diff('day', CAST(max(e.kickoff) AS date), CAST(t.kickoff AS date)) AS bigint) AS rest
      FROM team_rows t LEFT JOIN team_rows e ON e.team = t.team AND e.kickoff < t.kickoff
      GROUP BY t.match_id, t.side, t.team, t.kickoff""",
    "matchday": f"{_W},{_MATCHDAY} SELECT match_id, side, team, matchday FROM days",
    "head_to_head": f"""{_W},{_H2H} SELECT m.match_id, m.home_team, m.away_team, {_sum("pts", 3)} AS h2h3_points,
      {_sum("gf", 3)} AS h2h3_gf, {_sum("ga", 3)} AS h2h3_ga, count(back) FILTER (back <= 3) AS h2h3_n_used
      FROM contests m LEFT JOIN meet USING (match_id) GROUP BY m.match_id, m.home_team, m.away_team""",
    "promoted_flag": f"{_W},{_PROMOTED} SELECT * FROM promoted",
    "asof_join": f"""{_W},{RATINGS},{_ASOF} SELECT match_id, kickoff, team, side, CAST(valid_from AS timestamp) AS valid_from, rating
      FROM sides_rated""",
    "attach_sides": f"""{_W},{RATINGS},{_ASOF},
      two AS (SELECT match_id, max(rating) FILTER (side = 'H') AS rating_h, max(rating) FILTER (side = 'A') AS rating_a
        FROM sides_rated GROUP BY match_id)
      SELECT match_id, m.home_team, m.away_team, rating_h, rating_a, rating_h - rating_a AS rating_diff
      FROM contests m JOIN two USING (match_id)""",
    "enrich_asof": f"""WITH {CONTESTS}, feed AS (
        SELECT l_orderkey % 5 AS league, l_shipdate AS seen, sum(l_quantity) AS load FROM lineitem GROUP BY ALL)
      SELECT m.match_id, m.league, f.seen AS feed_seen, round(f.load, 6) AS feed_load
      FROM contests m ASOF LEFT JOIN feed f ON m.league = f.league AND m.kickoff > f.seen""",
    "build_features": f"""{_W},{RATINGS},{_ASOF},{_back("b", "")},{_back("o", "AND e.side = t.side")},{_H2H},{_PROMOTED},{_MATCHDAY},{_FEATURES}
      SELECT m.match_id, h.rating - a.rating AS rating_diff, h.form5_points AS form5_points_h, a.form5_points AS form5_points_a,
        h.form10_gd AS form10_gd_h, a.form10_gd AS form10_gd_a, oh.side5_points AS side5_points_h, oa.side5_points AS side5_points_a,
        oh.side10_gf AS side10_gf_h, oa.side10_ga AS side10_ga_a, h.rest AS rest_h, a.rest AS rest_a,
        h.matchday AS matchday_h, a.matchday AS matchday_a, h.promoted AS promoted_h, a.promoted AS promoted_a, hh.h2h3_points,
        CAST(greatest(h.last_played, a.last_played, h.valid_from, a.valid_from, hh.h2h_last) AS timestamp) AS max_src_ts
      FROM contests m JOIN per_side h ON h.match_id = m.match_id AND h.side = 'H'
      JOIN per_side a ON a.match_id = m.match_id AND a.side = 'A'
      LEFT JOIN own oh ON oh.match_id = m.match_id AND oh.side = 'H' LEFT JOIN own oa ON oa.match_id = m.match_id AND oa.side = 'A'
      LEFT JOIN hh ON hh.match_id = m.match_id""",
}
ORACLE["leakage_audit"] = f"""SELECT m.o_orderkey AS match_id, m.o_orderdate AS kickoff, f.max_src_ts
  FROM ({ORACLE["build_features"]}) f JOIN orders m ON m.o_orderkey = f.match_id
  WHERE f.max_src_ts >= m.o_orderdate"""
ORACLE["planted_leaks"] = f"""WITH {CONTESTS},
  late AS (SELECT match_id, kickoff, date_trunc('month', kickoff) + CASE WHEN league = 2 THEN INTERVAL 1 MONTH ELSE INTERVAL 0 MONTH END AS max_src_ts
    FROM contests WHERE league IN (2, 3))
  SELECT match_id, kickoff, max_src_ts FROM late WHERE max_src_ts >= kickoff"""
