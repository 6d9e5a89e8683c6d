"""Cases in which an operator once gave a wrong result or failed."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import corpus, form, panel
from touchline.operators.forecast import goals, ordinal
from touchline.operators.imbalance import auc, smote, uplift_by_decile
from touchline.operators.neighbours import nearest
from touchline.operators.rows import decay_weight, team_rows
from touchline.operators.skew import plan_chunks
from touchline.plans.features import build_features
from touchline.sources.derived import contests, ratings


def test_no_weight_at_or_after_the_cutoff(spark):
    rows = [(1, "2020-01-01"), (2, "2020-01-11"), (3, "2020-02-01")]
    m = spark.createDataFrame(rows, "id long, d string").select("id", F.col("d").cast("timestamp_ntz").alias("kickoff"))
    found = {r.id: r.weight for r in decay_weight(m, "2020-01-11 00:00:00", 0.1).collect()}
    assert found[1] == pytest.approx(2.718281828459045**-1) and found[2] is None and found[3] is None


@pytest.mark.parametrize("n, kept", [(2, 0), (3, 0), (4, 1)])
def test_no_edge_from_too_few_samples(spark, n, kept):
    corr = spark.createDataFrame([(1, "a", "b", n, 0.999999)], "subject int, src string, dst string, n long, r double")
    assert panel.pc_skeleton(corr).count() == kept


def test_fill_looks_every_marker_up_once(spark):
    docs = spark.createDataFrame(
        [(1, "[FILL: a] and [FILL: b] and [FILL: a] [FILL: c]"), (2, "plain"), (3, None)], "doc_id long, text string"
    )
    facts = spark.createDataFrame([("a", "[FILL: b]"), ("b", "Z"), ("c", " ")], "key string, value string")
    found = {r.doc_id: (r.text, r.n_unresolved) for r in corpus.fill(docs, facts).collect()}
    assert found == {1: ("[FILL: b] and Z and [FILL: b] [FILL: c]", 1), 2: ("plain", 0), 3: (None, 0)}


def test_empty_inputs_give_no_rows(spark):
    empty = spark.createDataFrame([], "id long, features array<double>, label int")
    assert nearest(empty, 3).isEmpty() and smote(empty).isEmpty()
    majority = spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)], "id long, features array<double>, label int")
    assert smote(majority).isEmpty()


def test_scores_that_are_no_numbers(spark, limits):
    nan, inf = float("nan"), float("inf")
    rows = [(float(i % 17), i % 3 == 0) for i in range(60)] + [(inf, True), (-inf, False), (nan, True), (None, False)]
    df = spark.createDataFrame([(s, int(y), i % 2, int(y)) for i, (s, y) in enumerate(rows)], "score double, label int, treated int, outcome int")

    def run():
        return auc(df).collect(), sorted(map(tuple, uplift_by_decile(df).collect()))

    plain = run()
    assert plain[0][0].n_pos + plain[0][0].n_neg == 62 and sum(r[1] for r in plain[1]) == 62
    limits(HOT_ROWS=10)
    assert run() == plain


def test_promotion_needs_the_season_before(spark):
    rows = [(1, 2000, 1, 2), (1, 2002, 1, 3), (1, 2003, 1, 4)]
    m = spark.createDataFrame(rows, "league int, season int, home_team long, away_team long")
    found = {(r.season, r.team): r.promoted for r in form.promoted_flag(m).collect()}
    assert found[(2002, 3)] is None and found[(2003, 4)] is True and found[(2003, 1)] is False


def test_texts_without_terms_stay(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "!!!"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.rep_id for r in corpus.copy_groups(docs).collect()} == {1: 1, 2: None, 3: None}
    assert {r.doc_id: r.reusable for r in corpus.reuse_verdict(docs).collect()} == {1: False, 2: False, 3: False}
    targets = spark.createDataFrame([(1, "one two"), (2, "???")], "target_id long, target_text string")
    asked = docs.withColumn("target_id", F.col("doc_id"))
    found = {r.doc_id: (r.n_terms, r.n_named) for r in corpus.term_containment(asked, targets).collect()}
    assert found == {1: (2, 2), 2: (None, None), 3: (None, None)}


def test_fast_decay_does_not_overflow(spark, sf_dir):
    m = contests(spark, sf_dir)
    sums = goals.training_pairs(m, [2000], 0.5)
    bad = [F.isnan(c) | (F.abs(c) == float("inf")) for c in ("w", "wh", "wa")]
    assert sums.filter(bad[0] | bad[1] | bad[2]).isEmpty() and sums.agg(F.max("w")).first()[0] <= 20


def test_ordinal_fit_stays_finite(spark):
    # One outcome only at every difference: the likelihood has no finite maximum.
    rows = [(1, x / 10, "H" if x > 0 else "A", 50) for x in range(-5, 6)]
    params = ordinal.fit(spark.createDataFrame(rows, "fold int, x double, y string, n long"))
    assert all(abs(v) < float("inf") for p in params.values() for v in p)


def test_a_far_off_date_does_not_stop_cutting(spark, limits):
    rows = [(1, i * 60_000_000) for i in range(400)] + [(1, -(10**17)), (1, 10**17)]
    df = spark.createDataFrame(rows, "k long, us long")
    limits(HOT_ROWS=50)
    chunks = plan_chunks(df, ["k"], "us", 86_400_000_000)
    assert chunks.tag(df).groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 110


def test_features_of_hot_teams(spark, sf_dir, limits):
    m = contests(spark, sf_dir).filter("match_id < 1200")
    rows = lambda: sorted(map(str, build_features(m, ratings(m)).collect()))
    assert not any(r[0] is None for r in team_rows(m).select("team").limit(5).collect())
    plain = rows()
    limits(HOT_ROWS=20)
    assert rows() == plain
