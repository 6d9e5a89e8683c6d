"""The chain of stages from files to reports, and its ledger."""

from pyspark.sql import functions as F

from touchline.operators.forecast.pool import Candidate
from touchline.plans import backtest, pipeline
from touchline.plans.registry.matches import CSV_COLUMNS
from touchline.sources.derived import contests, ratings
from touchline.sources.matches import read_matches, select_scope


def test_every_input_row_is_kept_or_explained(spark, sf_dir, tmp_path):
    columns = list(CSV_COLUMNS.values())
    good = "{},2000-03-0{} 12:00:00,{},1,{},{},1,0,{},3.0,4.0"
    lines = [
        good.format(1, 1, 2000, 5, 6, 2.0), good.format(2, 2, 2000, 5, 6, 2.0), good.format(3, 3, 2000, 6, 5, 1.0),
        good.format(4, 4, 2000, 7, 8, ""), "not a match", "5,never,2000,1,9,8,1,0,2.0,3.0,4.0",
        good.format(6, 5, 1990, 5, 6, 2.0), good.format(7, 6, 2001, 5, 6, 2.0), good.format(8, 7, 2000, 8, 7, 2.0),
    ]
    (tmp_path / "raw.csv").write_text("\n".join([",".join(columns), *lines]) + "\n")
    raw = read_matches(spark, str(tmp_path), columns, CSV_COLUMNS)
    raw = raw.cache()  # Spark cannot read the bad lines alone
    kept, ledger = pipeline.prepare(raw, [1], 1)
    assert sorted(r.match_id for r in kept.collect()) == [1, 8]
    found = {(r.match_id, r.rule) for r in ledger.filter("rule <> 'malformed'").collect() if r.match_id is not None}
    assert {(2, "repeat"), (3, "unpriced"), (4, "no_odds"), (6, "out_of_scope"), (7, "out_of_scope")} <= found
    bad = {r.line for r in ledger.filter("rule = 'malformed'").collect()}
    assert bad == {lines[4], lines[5]}
    rows = ledger.select(F.coalesce("line", F.col("match_id").cast("string")).alias("row")).distinct().count()
    assert kept.count() + rows == len(lines)


def test_choice_of_parameters_ignores_the_test_season(spark, sf_dir):
    m = select_scope(contests(spark, sf_dir), leagues=[0], n=5)
    frame = backtest.model_table(m, ratings(m))
    fold = max(backtest.all_seasons(m))
    grid = (Candidate(depth=2, rounds=3), Candidate(depth=4, rounds=3))
    changed = frame.withColumn(
        "outcome", F.when(F.col("season") >= fold, F.lit("D")).otherwise(F.col("outcome"))
    )
    first, second = (backtest.tuned(f, [fold], grid, 1) for f in (frame, changed))
    scores = first.scores.orderBy("candidate").collect()
    assert scores == second.scores.orderBy("candidate").collect() and first.choice == second.choice
    best = min(scores, key=lambda r: (r.rps, r.candidate))
    assert first.choice == {fold: int(best.candidate[-1])}
    key = lambda df: sorted((r.match_id, round(r.p_h, 9), round(r.p_d, 9)) for r in df.collect())
    assert key(first.predictions) == key(second.predictions)
    assert first.predictions.count() == frame.filter(F.col("season") == fold).count()
