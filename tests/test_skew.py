"""Hot groups give the same rows as the plain plans."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions.clock import DAY_US, micros
from touchline.operators import corpus, form, graph, panel, skew
from touchline.operators.asof import asof_join
from touchline.operators.imbalance import auc, smote, uplift_by_decile
from touchline.operators.neighbours import nearest
from touchline.operators.rows import team_rows
from touchline.operators.skew import busy_instants, number_within, plan_chunks, totals_before
from touchline.plans.features import build_features
from touchline.sources.derived import contests, labelled_vectors, membership, ratings, table
from touchline.sources.derived import panel as event_panel


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def m(spark, sf_dir):
    """One team holds a third of all team rows."""
    df = contests(spark, sf_dir)
    hot = F.when(F.col("match_id") % 3 < 2, F.lit(999)).otherwise(F.col("home_team"))
    return df.withColumn("home_team", hot.cast("long")).persist()


WINDOWED = {
    "form": lambda m: form.rolling_form(team_rows(m), (5, 10), last_ts="last"),
    "own side": lambda m: form.rolling_form(team_rows(m), 5, side="own"),
    "rest": lambda m: form.rest_days(team_rows(m)),
    "matchday": lambda m: form.matchday(team_rows(m)),
    "h2h": lambda m: form.head_to_head(m, 3),
    "asof": lambda m: asof_join(team_rows(m), ratings(m), ["team"], "kickoff", "valid_from"),
}


@pytest.mark.parametrize("name", WINDOWED)
def test_chunks_change_nothing(name, m, limits):
    plain = rows_of(WINDOWED[name](m))
    limits(HOT_ROWS=25)
    assert rows_of(WINDOWED[name](m)) == plain


def test_busy_day_is_cut_finer(spark, limits):
    """All rows of a key within one day, many of them at equal times."""
    rows = [(1, i, f"2024-03-01 {i % 20:02d}:{i % 7:02d}:00", i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "team long, match_id long, at string, points long").select(
        "team", "match_id", F.col("at").cast("timestamp_ntz").alias("kickoff"), "points"
    )

    def run():
        return rows_of(form.last_n(df, ["team"], [5], ["points"], last_ts="last"))

    plain = run()
    limits(HOT_ROWS=20)
    chunks = plan_chunks(df.withColumn("us", micros("kickoff")), ["team"], "us", DAY_US)
    assert chunks.table.select("_chunk").distinct().count() > 10
    assert run() == plain
    everything = [(r["kickoff"], r["match_id"], r["points"]) for r in df.collect()]
    for _, _, at, _, found, *_ in plain:
        last = sorted((r for r in everything if r[0] < at), reverse=True)[:5]
        assert found == (sum(p for _, _, p in last) if last else None)


def test_chunks_change_nothing_without_broadcast(m, limits):
    plain = rows_of(WINDOWED["form"](m))
    limits(HOT_ROWS=25, BROADCAST_ROWS=1)
    assert rows_of(WINDOWED["form"](m)) == plain


@pytest.fixture(scope="module")
def busy(spark):
    """One team plays most of its matches at one instant, others at few."""
    rows = [(i, 7 if i % 4 else i % 3, f"2024-03-{1 + (i % 50 == 1):02d} 1{i % 3 if i % 10 == 0 else 5}:00:00", i % 4, i % 3) for i in range(600)]
    rows += [(1000 + i, None, "2024-03-01 15:00:00", 1, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "match_id long, team long, at string, points long, gf long")
    return df.select(
        "match_id", "team", F.col("at").cast("timestamp_ntz").alias("kickoff"), "points", "gf", F.lit(1).alias("ga"),
        F.lit(1).alias("league"), F.lit(2024).alias("season"), F.when(F.col("match_id") % 2 == 0, "H").otherwise("A").alias("side"),
    ).persist()


def _feed(df):
    """Two values at an instant, and many at the busy one."""
    at = df.select("team", F.col("kickoff").alias("valid_from"), (F.col("match_id") % 40).alias("rating"))
    return at.unionByName(at.withColumn("valid_from", F.expr("valid_from - INTERVAL 1 DAY")))


BUSY = {
    "form": lambda t: form.rolling_form(t, (2, 10), last_ts="last"),
    "own side": lambda t: form.rolling_form(t, 5, side="own"),
    "rest": form.rest_days,
    "matchday": form.matchday,
    "asof": lambda t: asof_join(t, _feed(t), ["team"], "kickoff", "valid_from"),
    "asof of a busy feed": lambda t: asof_join(t.filter("match_id % 37 = 0"), _feed(t), ["team"], "kickoff", "valid_from"),
}


@pytest.mark.parametrize("name", BUSY)
def test_busy_instants_change_nothing(name, busy, limits):
    plain = rows_of(BUSY[name](busy))
    limits(HOT_ROWS=8)
    assert busy_instants(busy.withColumn("us", micros("kickoff")), ["team"], "us") is not None
    assert rows_of(BUSY[name](busy)) == plain


def test_a_busy_instant_is_spread(spark, limits):
    """A million rows of one key and one instant."""
    n = 1_000_000
    df = spark.range(n).select(
        F.col("id").alias("match_id"), F.lit(3).alias("team"),
        F.expr("timestamp_ntz'2024-05-01 15:00:00' + make_dt_interval(if(id < 5, -1, 0))").alias("kickoff"),
        (F.col("id") % 4).alias("points"),
    )
    limits(HOT_ROWS=50_000)
    rows = df.withColumn("us", micros("kickoff"))
    parts = busy_instants(rows, ["team"], "us")
    assert [r["_parts"] for r in parts.collect()] == [20]
    found = form.last_n(df, ["team"], [5], ["points"])
    by_part = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by_part) == n and len(by_part) > 1
    assert found.filter("form5_n_used = 5 AND form5_points = 0 + 1 + 2 + 3 + 0").count() == n - 5
    last = asof_join(df, df.select("team", F.col("kickoff").alias("since"), F.col("points").alias("best")), ["team"], "kickoff", "since")
    assert last.filter("best = 3").count() == n - 5


def test_sliding_corr_over_blocks(spark, sf_dir):
    p = event_panel(spark, sf_dir)
    plain = rows_of(panel.sliding_corr(p, 4).withColumn("r", F.round("r", 9)))
    assert sum(r[-1] is not None for r in plain) > 50
    for tile, block in ((2, 3), (1, 7)):
        assert rows_of(panel.sliding_corr(p, 4, tile, block).withColumn("r", F.round("r", 9))) == plain


def test_pairs_of_hot_items(spark, limits):
    """One item holds a third of the rows."""
    rows = [(0, i) for i in range(60)] + [(1 + i % 40, (i * 7) % 61) for i in range(120)]
    df = spark.createDataFrame(rows, "item long, member long")
    plain = rows_of(graph.co_edges(df))
    limits(PAIR_ROWS=5)
    assert rows_of(graph.co_edges(df)) == plain
    items = {}
    for i, x in set(rows):
        items.setdefault(i, set()).add(x)
    brute = {}
    for members in items.values():
        for a in members:
            for b in members:
                if a < b:
                    brute[a, b] = brute.get((a, b), 0) + 1
    assert dict(((a, b), w) for a, b, w in plain) == brute


def test_number_within(spark, limits):
    df = spark.createDataFrame([(k, (i * 37) % 101) for k in (1, 2) for i in range(101)], "k long, o long")
    limits(HOT_ROWS=10)
    assert all(r["o"] == r["n"] for r in number_within(df, ["k"], "o", 4, "n").collect())


def test_totals_before(spark, limits):
    df = spark.createDataFrame([(float(i) / 7, i) for i in range(300)], "s double, v long")
    limits(HOT_ROWS=20)
    found = {r["v"]: r["v_before"] for r in totals_before(df, "s", ["v"]).collect()}
    assert found == {i: i * (i - 1) // 2 for i in range(300)}


def test_auc_and_uplift_with_parts(spark, limits):
    rng = np.random.default_rng(5)
    rows = [(float(round(s, 2)), int(y), int(t)) for s, y, t in zip(rng.uniform(size=600), rng.integers(0, 2, 600), rng.integers(0, 2, 600), strict=True)]
    df = spark.createDataFrame(rows, "score double, label int, treated int").withColumn("outcome", F.col("label"))
    plain = (rows_of(auc(df)), rows_of(uplift_by_decile(df)))
    limits(HOT_ROWS=10)
    assert (rows_of(auc(df)), rows_of(uplift_by_decile(df))) == plain
    pos = [s for s, y, _ in rows if y == 1]
    neg = [s for s, y, _ in rows if y == 0]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert plain[0][0][2] == pytest.approx(won / len(pos) / len(neg))


def test_neighbours_in_blocks(spark, sf_dir, limits):
    """Third of the vectors are copies; blocks and pivots against brute force."""
    vectors = labelled_vectors(spark, sf_dir).limit(120).select("id", "features").collect()
    data = [(r["id"], list(vectors[0]["features"] if r["id"] % 3 == 0 else r["features"])) for r in vectors]
    df = spark.createDataFrame(data, "id long, features array<double>")
    limits(PAIR_ROWS=16)
    found = {}
    for r in nearest(df, 4).collect():
        found.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    for i, x in data:
        brute = sorted((math.dist(x, y), j) for j, y in data if j != i)[:4]
        mine = sorted(found[i])
        assert [n for _, n, _ in mine] == [j for _, j in brute]
        assert [d for _, _, d in mine] == pytest.approx([d for d, _ in brute])


def test_smote_points_lie_between_parents(spark, sf_dir):
    df = labelled_vectors(spark, sf_dir)
    sizes = df.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in sizes}
    features = {r["id"]: np.array(r["features"]) for r in df.collect()}
    made = smote(df, k=5, ratio=1.0).collect()
    assert made and abs(len(made) - (n[0] - n[1])) <= n[1]
    assert rows_of(smote(df, k=5, ratio=1.0)) == sorted((tuple(r) for r in made), key=repr)
    for r in made:
        a, b, x = features[r["id"]], features[r["neighbour"]], np.array(r["features"])
        assert np.all(x >= np.minimum(a, b) - 1e-12) and np.all(x <= np.maximum(a, b) + 1e-12)
        assert r["id"] != r["neighbour"]


def test_near_duplicates_with_hot_shingles(spark, sf_dir, limits):
    """A third of the texts share a passage, a third are copies of one text."""
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(words[:60])
    docs = [(i, passage + " " + " ".join(f"x{i}y{j}" for j in range(5 + i % 4))) for i in range(30)]
    docs += [(100 + i, " ".join(words[100:180])) for i in range(30)]
    docs += [(200 + i, " ".join(words[200 : 290 - (i % 3)])) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")

    def grams(text):
        t = text.split()
        return frozenset(tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 1)))

    reps = {}
    for i, text in sorted(docs):
        reps.setdefault(grams(text), i)
    brute = sorted(
        (a, b)
        for s, a in reps.items()
        for t, b in reps.items()
        if a < b and len(s & t) / len(s | t) >= 0.8
    )
    found = sorted((r["doc_a"], r["doc_b"]) for r in corpus.near_duplicates(df).collect())
    assert found == brute and brute
    limits(PAIR_ROWS=3, BROADCAST_ROWS=2)
    assert sorted((r["doc_a"], r["doc_b"]) for r in corpus.near_duplicates(df).collect()) == brute


def test_corpus_tables_without_broadcast(spark, sf_dir, limits):
    docs = table(spark, sf_dir, "documents").withColumn("target_id", F.col("doc_id") % 40)
    goals = table(spark, sf_dir, "benchmark").toDF("target_id", "target_text")
    plain = rows_of(corpus.term_containment(docs, goals))
    limits(BROADCAST_ROWS=1)
    assert rows_of(corpus.term_containment(docs, goals)) == plain


def test_walks_follow_edges(spark, sf_dir, limits):
    edges = graph.co_edges(membership(spark, sf_dir))
    limits(HOT_ROWS=3)
    ties = {(r["a"], r["b"]) for r in edges.collect()}
    ties |= {(b, a) for a, b in ties}
    found = graph.walks(edges, 3, 5).collect()
    assert found
    for r in found:
        assert len(r["path"]) == 5
        assert all(step in ties for step in zip(r["path"], r["path"][1:], strict=False))


def test_tasks_of_the_feature_table_are_not_merged(spark, sf_dir, monkeypatch):
    """With more rows there are more tasks, not larger ones; the rows stay the same."""
    m = contests(spark, sf_dir)
    plain = build_features(m, ratings(m))
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    dealt = build_features(m, ratings(m))
    parts = 2 * m.count() // 100
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    for keys in ("team", "_p1", "match_id"):
        assert re.search(rf"hashpartitioning\({keys}#\w+(, _p2#\w+)?, {parts}\), REPARTITION_BY_NUM", plan), keys
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
