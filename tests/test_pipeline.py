"""Leakage, ingest, stages and the fitted forecasters."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import folds
from touchline.operators.audits import leakage_audit, moved_features
from touchline.operators.forecast.boosting import model_frame
from touchline.operators.forecast.ordinal import elo_ordered_logit
from touchline.operators.forecast.pool import Candidate
from touchline.operators.forecast.reference import market
from touchline.operators.imbalance import churn_table
from touchline.operators.scoring import ablation, predictions, score_input
from touchline.plans.backtest import backtest, tuned
from touchline.plans.features import build_features, rated_matches
from touchline.plans.registry.matches import CSV_COLUMNS
from touchline.sources.derived import contests, ratings, table
from touchline.sources.matches import read_matches, select_scope
from touchline.sources.stages import read_stage, write_stage
from touchline.streaming.ingest import ingest_incremental

NAMES = list(CSV_COLUMNS.values())


@pytest.fixture(scope="module")
def m(spark, sf_dir):
    return select_scope(contests(spark, sf_dir), leagues=range(5), n=12).persist()


def test_no_leakage_and_future_changes_do_not_move_features(spark, m):
    """Results after T are rewritten; nothing known at T may change."""
    feed = ratings(m)
    cut = "1998-06-01 00:00:00"
    later = F.col("kickoff") >= F.lit(cut).cast("timestamp_ntz")
    changed = m.withColumns(
        {
            "home_goals": F.when(later, F.col("home_goals") + 3).otherwise(F.col("home_goals")),
            "away_goals": F.when(later, F.lit(0).cast("long")).otherwise(F.col("away_goals")),
        }
    )
    drop = ["home_goals", "away_goals"]
    before = build_features(m, feed)
    assert leakage_audit(before).isEmpty()
    after = build_features(changed, feed)
    until = F.lit(cut).cast("timestamp_ntz")
    assert moved_features(before.drop(*drop), after.drop(*drop), until).isEmpty()
    # The check can fail: the same rewrite moves later features.
    assert not before.drop(*drop).exceptAll(after.drop(*drop)).isEmpty()


def test_split_audit_flags_a_bad_split(m):
    good = folds.walk_forward(m, 3)
    assert all(r["ok"] for r in folds.split_audit(good).collect())
    bad = good.withColumn("role", F.when(F.col("match_id") % 2 == 0, "train").otherwise("test"))
    assert not all(r["ok"] for r in folds.split_audit(bad).collect())


def _write_csv(df, folder):
    df.select(*[F.col(o).alias(t) for o, t in CSV_COLUMNS.items()]).coalesce(1).write.mode("append").option("header", True).csv(folder)


def test_ingest_resumes(spark, m, tmp_path):
    src, dst, state = (str(tmp_path / n) for n in ("src", "dst", "state"))

    def run():
        ingest_incremental(spark, src, dst, state, NAMES, CSV_COLUMNS)
        return read_stage(spark, dst).count()

    first, second = m.filter("league < 3"), m.filter("league = 3")
    _write_csv(first, src)
    n = first.count()
    assert run() == n
    assert run() == n
    _write_csv(second, src)
    assert run() == n + second.count()


def test_malformed_lines_are_kept(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text(
        ",".join(NAMES) + "\n1,2020-01-01T15:00:00,2020,1,10,20,2,0,1.8,3.5,4.5\nx,not a date,2020,1,10,20,2,0,,,\n"
    )
    rows = read_matches(spark, str(folder), NAMES, CSV_COLUMNS).orderBy("match_id").collect()
    assert len(rows) == 2
    assert rows[0]["_malformed"] and not rows[1]["_malformed"]
    assert rows[1]["match_id"] == 1 and rows[1]["odds_a"] == 4.5


def test_missing_column_becomes_null(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    names = [c for c in NAMES if not c.startswith("O")]
    (folder / "a.csv").write_text(",".join(names) + "\n1,2020-01-01T15:00:00,2020,1,10,20,2,0\n")
    row = read_matches(spark, str(folder), names, CSV_COLUMNS).first()
    assert row["home_goals"] == 2 and row["odds_h"] is None


def test_stage_replaces_only_its_partitions(spark, m, tmp_path):
    path = str(tmp_path / "stage")
    write_stage(m, path)
    write_stage(m.filter("league = 1 AND season = 1998").limit(1), path)
    left = read_stage(spark, path)
    assert left.filter("league = 1 AND season = 1998").count() == 1
    assert left.filter("league <> 1").count() == m.filter("league <> 1").count()


def test_predictions_prune_partitions(spark, m, tmp_path):
    path = str(tmp_path / "pred")
    write_stage(market(m), path)
    out = predictions(read_stage(spark, path), m, season=1998, league=2)
    assert out.count() > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "season" in plan


def test_elo_probabilities(spark, m):
    pred = elo_ordered_logit(rated_matches(m, ratings(m)), folds.test_seasons(m, 2))
    known = pred.filter("p_h IS NOT NULL")
    assert known.filter("abs(p_h + p_d + p_a - 1) > 1e-9 OR least(p_h, p_d, p_a) < 0").isEmpty()
    assert known.select("fold").distinct().count() == 2


def test_backtest_and_gates(spark, m, sf_dir):
    feed = ratings(contests(spark, sf_dir))
    scored = backtest(m, feed, n_folds=1).persist()
    n = {r["model"]: r["count"] for r in scored.groupBy("model").count().collect()}
    assert set(n) == {"market", "base_rate", "elo_logit", "dixon_coles", "gbm"}
    assert n["base_rate"] == n["dixon_coles"] == n["gbm"] >= n["market"]
    assert scored.filter("abs(p_h + p_d + p_a - 1) > 1e-9").isEmpty()
    gap = ablation(scored.filter("model = 'base_rate'"), scored.filter("model = 'gbm'")).first()
    assert gap["n"] == n["gbm"] and gap["keep"] == (gap["rps_gap"] < 0)


def test_tuning_stays_inside_training(spark, m, sf_dir):
    frame = model_frame(build_features(m, ratings(m))).persist()
    grid = (Candidate(depth=1, rounds=2), Candidate(depth=2, rounds=2))
    found = tuned(frame, [2000], grid, n_inner=1)
    rows = found.scores.collect()
    assert {r["candidate"] for r in rows} == {"candidate_0", "candidate_1"}
    assert {r["n"] for r in rows} == {m.filter("season = 1999").count()}
    assert [r["candidate"] for r in rows if r["chosen"]] == [f"candidate_{found.choice[2000]}"]
    assert found.predictions.count() == m.filter("season = 2000").count()


def test_churn_uses_only_the_past(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    later = F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    changed = events.withColumn("value", F.when(later, 1e6).otherwise(F.col("value")))
    a, b = (churn_table(e, "2024-01-20", 5).drop("churned") for e in (events, changed))
    assert a.exceptAll(b).isEmpty()


def test_scored_ignores_unpriced(m):
    pred = market(m)
    assert score_input(pred, m).count() == pred.filter("p_h IS NOT NULL").count() < pred.count()
