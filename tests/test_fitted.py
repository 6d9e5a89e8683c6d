"""Hash-seeded and fitted queries: invariants on the small tables."""

from touchline.operators import graph
from touchline.operators.imbalance import churn_table
from touchline.plans import registry
from touchline.sources.derived import table

Q = registry.queries()


def test_split_half_and_permutation(spark, sf_dir):
    first = {r["subject"]: r["stability"] for r in Q["split_half"](spark, sf_dir).collect()}
    again = {r["subject"]: r["stability"] for r in Q["split_half"](spark, sf_dir).collect()}
    assert first == again and len(first) == 15
    assert all(v is None or -1.000001 <= v <= 1.000001 for v in first.values())
    for r in Q["permute"](spark, sf_dir).collect():
        assert 0 < r["p"] <= 1 and 0 < r["rounds"] <= 99


def test_node_vectors(spark, sf_dir):
    walked = {int(n) for r in Q["random_walks"](spark, sf_dir).collect() for n in r["path"].split("-")}
    rows = Q["node_embed"](spark, sf_dir).collect()
    assert walked and {r["node"] for r in rows} == walked
    assert len(rows) == 8 * len(walked) and any(r["x"] for r in rows)
    empty = spark.createDataFrame([], "a long, b long, weight long")
    assert graph.node_embed(empty).isEmpty() and graph.walks(empty, 2, 3).isEmpty()


def test_classifiers_and_scenarios(spark, sf_dir):
    users = churn_table(table(spark, sf_dir, "events"), "2024-01-20", 1).count()
    n = {r["model"]: r["count"] for r in Q["classify"](spark, sf_dir).groupBy("model").count().collect()}
    assert n == {"svm": users, "logistic": users, "forest": users}
    rows = {r["scenario"]: r for r in Q["scenario_grid"](spark, sf_dir).collect()}
    assert rows["as_is"]["shift"] == 0 and {r["n"] for r in rows.values()} == {users}
    assert set(rows) == {"as_is", "more_activity", "higher_value", "recent_contact"}


def test_importance_of_every_fold(spark, sf_dir):
    rows = Q["feature_importance"](spark, sf_dir).collect()
    folds = {r["fold"] for r in rows}
    assert len(folds) == 5 and {r["fold"] for r in Q["ts_cv"](spark, sf_dir).collect()} == folds
    for fold in folds:
        found = [r["importance"] for r in sorted(rows, key=lambda r: r["rank"]) if r["fold"] == fold]
        assert len(found) == 10 and found == sorted(found, reverse=True) and 0 < sum(found) <= 1.00001

