"""Hand-worked cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import outcomes as fo
from touchline.operators import form, scoring
from touchline.operators.asof import asof_join
from touchline.operators.forecast import goals, ordinal
from touchline.operators.quality import apply_exclusions, default_rules, flag_repeats
from touchline.operators.rows import devig, team_rows
from touchline.plans.registry.common import scaled_round

P = (0.5, 0.3, 0.2)


def day(n, hour=15):
    return dt.datetime(2020, 1, 1, hour) + dt.timedelta(days=n)


def matches(spark, rows):
    """rows: (id, day, season, home, away, home goals, away goals)."""
    data = [(i, day(d), s, 1, h, a, hg, ag, 1.8, 3.5, 4.5) for i, d, s, h, a, hg, ag in rows]
    return spark.createDataFrame(
        data,
        "match_id long, kickoff timestamp_ntz, season int, league long, home_team long, away_team long,"
        "home_goals long, away_goals long, odds_h double, odds_d double, odds_a double",
    )


def test_rps_and_brier_by_hand(spark):
    df = spark.createDataFrame([(*P, o) for o in "HDA"], "p_h double, p_d double, p_a double, y string")
    rows = {r["y"]: r for r in df.select("y", fo.rps("y").alias("rps"), fo.brier("y").alias("b"), fo.log_loss("y").alias("l")).collect()}
    assert [round(rows[o]["rps"], 9) for o in "HDA"] == [0.145, 0.145, 0.445]
    assert [round(rows[o]["b"], 9) for o in "HDA"] == [0.38, 0.78, 0.98]
    assert rows["A"]["l"] == pytest.approx(-math.log(0.2))


def test_argmax_ties_go_in_order(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.4, 0.2, 0.4)], "p_h double, p_d double, p_a double")
    assert [r[0] for r in df.select(fo.favourite()).collect()] == ["H", "D", "H"]


def test_devig(spark):
    odds = [(1.8, 3.5, 4.5), (1.8, None, 4.5), (1.0, 3.5, 4.5)]
    df = devig(spark.createDataFrame(odds, "odds_h double, odds_d double, odds_a double"))
    good, missing, unusable = df.select("p_h", "p_d", "p_a").collect()
    assert [round(v, 6) for v in good] == [0.522388, 0.268657, 0.208955]
    assert sum(good) == pytest.approx(1)
    assert list(missing) == [None] * 3 and list(unusable) == [None] * 3


def test_first_matchday_and_ties(spark):
    m = matches(spark, [(1, 0, 2019, 10, 20, 2, 0), (2, 5, 2019, 10, 30, 1, 1), (3, 5, 2019, 20, 10, 0, 3), (4, 9, 2019, 10, 20, 0, 1)])
    t = form.rolling_form(team_rows(m), 2)
    rows = {(r["match_id"], r["team"]): r for r in t.collect()}
    assert rows[1, 10]["form2_points"] is None and rows[1, 10]["form2_n_used"] == 0
    # Matches 2 and 3 of team 10 share a kick-off: neither sees the other.
    assert rows[2, 10]["form2_points"] == 3 == rows[3, 10]["form2_points"]
    # Last two before match 4 are 2 and 3, not 1.
    assert rows[4, 10]["form2_points"] == 4 and rows[4, 10]["form2_gd"] == 3
    rest = {(r["match_id"], r["team"]): r["rest"] for r in form.rest_days(team_rows(m)).collect()}
    assert rest[1, 10] is None and rest[2, 10] == 5 and rest[4, 10] == 4
    days = {(r["match_id"], r["team"]): r["matchday"] for r in form.matchday(team_rows(m)).collect()}
    assert [days[i, 10] for i in (1, 2, 3, 4)] == [1, 2, 2, 4]


def test_head_to_head_turns_to_the_home_side(spark):
    m = matches(spark, [(1, 0, 2019, 10, 20, 2, 0), (2, 5, 2019, 20, 10, 1, 1), (3, 9, 2019, 20, 10, 0, 0)])
    rows = {r["match_id"]: r for r in form.head_to_head(m, 3).collect()}
    assert rows[1]["h2h3_points"] is None
    assert (rows[2]["h2h3_points"], rows[2]["h2h3_gf"], rows[2]["h2h3_ga"]) == (0, 0, 2)
    assert (rows[3]["h2h3_points"], rows[3]["h2h3_gf"], rows[3]["h2h3_ga"]) == (1, 1, 3)


def test_promoted(spark):
    m = matches(spark, [(1, 0, 2019, 10, 20, 2, 0), (2, 400, 2020, 10, 30, 1, 1)])
    rows = {(r["season"], r["team"]): r["promoted"] for r in form.promoted_flag(m).collect()}
    assert rows == {(2019, 10): None, (2019, 20): None, (2020, 10): False, (2020, 30): True}


def test_promoted_team_without_history(spark):
    m = matches(spark, [(1, 0, 2019, 10, 20, 2, 0), (2, 400, 2020, 10, 30, 1, 1)])
    row = [r for r in form.rolling_form(team_rows(m), 5).collect() if r["team"] == 30][0]
    assert row["form5_points"] is None and row["form5_n_used"] == 0


def test_asof_skips_the_equal_time(spark):
    left = spark.createDataFrame([(1, day(5)), (1, day(0)), (2, day(5))], "k long, at timestamp_ntz")
    right = spark.createDataFrame([(1, day(5), 9.0), (1, day(3), 7.0)], "k long, seen timestamp_ntz, v double")
    rows = {(r["k"], r["at"]): r["v"] for r in asof_join(left, right, ["k"], "at", "seen").collect()}
    assert rows == {(1, day(5)): 7.0, (1, day(0)): None, (2, day(5)): None}


def test_calibration_edge(spark):
    df = spark.createDataFrame([("m", 1.0, 0.0, 0.0, "H")], "model string, p_h double, p_d double, p_a double, outcome string")
    bins = {(r["class"], r["bin"]): r["n"] for r in scoring.calibration(df).collect()}
    assert bins[("H", 9)] == 1 and bins[("D", 0)] == 1 and bins[("all", 0)] == 2


def test_exclusions_conserve_rows(spark):
    m = matches(spark, [(1, 0, 2019, 10, 20, 2, 0), (2, 5, 2019, 10, 20, 1, 1), (3, 6, 2019, 20, 10, None, 1)])
    kept, ledger = apply_exclusions(flag_repeats(m), default_rules())
    assert {r["match_id"] for r in kept.collect()} == {1}
    assert {(r["match_id"], r["rule"]) for r in ledger.collect()} == {(2, "repeat"), (3, "no_result")}
    assert kept.count() + ledger.select("match_id").distinct().count() == m.count()


def test_ordered_logit_recovers_parameters(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=8000), 2)
    beta, low, high = 0.9, -1.0, 0.4
    u = rng.uniform(size=x.size)
    pa, pad = 1 / (1 + np.exp(-(low - beta * x))), 1 / (1 + np.exp(-(high - beta * x)))
    y = np.where(u < pa, "A", np.where(u < pad, "D", "H"))
    rows = [(2000, float(a), str(b), 1) for a, b in zip(x, y, strict=True)]
    train = spark.createDataFrame(rows, "fold int, x double, y string, n long")
    found = ordinal.fit(train.groupBy("fold", "x", "y").agg(F.sum("n").alias("n")).persist())[2000]
    assert found == pytest.approx((beta, low, high), abs=0.08)


def test_score_matrix_and_outcomes_agree(spark):
    lam = spark.createDataFrame([(1, 1.4, 1.1, -0.08), (2, 0.7, 2.0, 0.05)], "match_id long, lam double, mu double, rho double")
    cells = goals.score_matrix(lam).collect()
    probs = {r["match_id"]: r for r in goals.outcome_probs(lam).collect()}
    for i in (1, 2):
        mine = [c for c in cells if c["match_id"] == i]
        assert sum(c["prob"] for c in mine) == pytest.approx(1)
        assert probs[i]["p_h"] == pytest.approx(sum(c["prob"] for c in mine if c["hg"] > c["ag"]))
        assert probs[i]["p_d"] == pytest.approx(sum(c["prob"] for c in mine if c["hg"] == c["ag"]))


def test_goal_rates_recovered(spark):
    """Simulated league: attack order and home advantage come back."""
    rng = np.random.default_rng(3)
    strength = {t: 0.6 + 0.2 * t for t in range(6)}
    rows, i = [], 0
    for _ in range(40):
        for h in strength:
            for a in strength:
                if h != a:
                    i += 1
                    rows.append((i, i // 50, 2019, h, a, int(rng.poisson(1.5 * strength[h])), int(rng.poisson(strength[a]))))
    rows += [(i + 1, 300, 2020, 0, 1, 0, 0), (i + 2, 300, 2020, 0, 99, 0, 0)]
    m = matches(spark, rows)
    pairs = goals.training_pairs(m, [2020], 0.0)
    rates = {r["team"]: r for r in goals.fit_rates(pairs).collect()}
    assert rates[0]["g"] == pytest.approx(1.5, abs=0.1)
    mean = sum(strength.values()) / 6
    for t, s in strength.items():
        assert rates[t]["a"] == pytest.approx(s / mean, abs=0.12)
    pred = {r["match_id"]: r for r in goals.dixon_coles(m, [2020], 0.0).collect()}
    assert set(pred) == {i + 1, i + 2}  # also the match of a team never seen
    for r in pred.values():
        assert r["p_h"] + r["p_d"] + r["p_a"] == pytest.approx(1)


def test_no_division_by_zero(spark):
    """Empty classes and constant groups give nulls, not errors."""
    from touchline.operators.imbalance import auc, class_metrics, uplift_by_decile
    from touchline.operators.panel import edge_contrast, granger1, pair_corr

    df = spark.createDataFrame([(0.5, 0, 0), (0.7, 0, 0)], "score double, label int, predicted int")
    assert class_metrics(df).first()["recall"] is None
    assert auc(df).first()["auc"] is None
    lifts = uplift_by_decile(df.withColumns({"treated": F.lit(1), "outcome": F.col("label")})).collect()
    assert all(r["rate_control"] is None and r["uplift"] is None for r in lifts)
    flat = spark.createDataFrame([(s, r, t, 1.0) for s in range(4) for r in "ab" for t in range(9)], "subject long, region string, t long, x double")
    corr = pair_corr(flat)
    assert [r["r"] for r in corr.collect()] == [None] * 4
    groups = flat.select("subject").distinct().withColumn("grp", (F.col("subject") % 2).cast("int"))
    assert edge_contrast(corr.withColumn("r", F.lit(0.5)), groups).first()["t"] is None
    assert all(r["f"] is None for r in granger1(flat).collect())


def test_score_matrix_is_generated_code(spark):
    """No cell is worked out by an interpreted lambda; a match without rates keeps its 121 rows."""
    lam = spark.createDataFrame([(1, 1.4, 1.1, -0.08), (2, None, 2.0, 0.05)], "match_id long, lam double, mu double, rho double")
    cells = goals.score_matrix(lam)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan
    found = cells.collect()
    assert len(found) == 242 and sum(c["prob"] is None for c in found) == 121


def test_scaled_round(spark):
    rows = [(x,) for x in (0.1234564, 0.1234565, 0.5, 2.5e-6, -0.0000004, -1.5000007, None, float("inf"), 1e300)]
    df = spark.createDataFrame([*rows, (float("nan"),)], "x double").select("x", scaled_round(F.col("x"), 6).alias("y"))
    found = [r["y"] for r in df.collect()]
    assert found[:9] == [0.123456, 0.123457, 0.5, 3e-6, 0.0, -1.500001, None, float("inf"), 1e300]
    assert found[9] != found[9] and str(found[4]) == "0.0"


def test_outcome_sums_are_worked_out_once(spark):
    """No interpreted lambda, and a filter on a probability does not work the sums out again; rows
    without a rate or a correction keep their other columns."""
    rows = [(1, "a", 1.4, 1.1, -0.08), (2, None, None, 2.0, 0.05), (3, "c", 1.0, 1.0, None), (3, "c", 1.0, 1.0, 0.0)]
    lam = spark.createDataFrame(rows, "match_id long, note string, lam double, mu double, rho double")
    probs = goals.outcome_probs(lam)
    assert probs.columns == [*lam.columns, "p_h", "p_d", "p_a"]
    priced = probs.filter("p_h IS NOT NULL").withColumn("_twice", F.col("p_h") * F.col("p_h"))
    plan = priced._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "zip_with(" not in plan and plan.count("MapInArrow") == 1
    assert [(r["match_id"], r["note"]) for r in priced.orderBy("match_id").collect()] == [(1, "a"), (3, "c")]
    found = sorted(map(tuple, probs.select("match_id", "note", F.isnull("p_h"), F.isnull("p_d"), F.isnull("p_a")).collect()), key=str)
    assert found == sorted([(1, "a", *[False] * 3), (2, None, *[True] * 3), (3, "c", *[True] * 3), (3, "c", *[False] * 3)], key=str)
    draw = [r for r in probs.collect() if r["rho"] == 0.0][0]
    assert draw["p_h"] == pytest.approx(draw["p_a"]) and draw["p_h"] + draw["p_d"] + draw["p_a"] == pytest.approx(1)


def test_rated_matches_are_read_once(spark):
    """Fit and predictions share one pass over the rated matches."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(4)
    rows = [(i, 2000 + i % 3, 1, int(rng.integers(3)), int(rng.integers(3)), float(rng.integers(-3, 4))) for i in range(300)]
    rated = spark.createDataFrame(rows, "match_id long, season int, league long, home_goals long, away_goals long, rating_diff double")
    found = ordinal.elo_ordered_logit(rated.mapInArrow(run, rated.schema), [2001, 2002]).collect()
    assert len(found) == 200 and read.value == 300
