"""Imbalanced learning: weights, synthetic rows, metrics, churn, uplift."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import outcomes as fo
from touchline.operators import imbalance as im
from touchline.operators.neighbours import nearest
from touchline.operators.probing import nearest_probed
from touchline.operators.rows import devig
from touchline.plans.registry.common import CONTESTS, rounded
from touchline.sources.derived import contests, labelled_vectors, table

K = 5  # neighbours
CHURN_COLUMNS = ["n_events", "n_types", "value_sum", "value_mean", "recency"]


def class_ratio(spark, sf_dir):
    """Toxicity labels of the documents that have one."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labelled = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return rounded(im.imbalance(labelled, "toxic"))


def neighbours(spark, sf_dir):
    return rounded(nearest(labelled_vectors(spark, sf_dir), K))


def _made(spark, sf_dir, search=None):
    made = im.smote(labelled_vectors(spark, sf_dir), k=K, ratio=1.0, search=search)
    return rounded(made.select("id", "copy", "neighbour", F.posexplode("features").alias("dim", "x"), "label"))


def smote(spark, sf_dir):
    return _made(spark, sf_dir)


def smote_probed(spark, sf_dir):
    return _made(spark, sf_dir, nearest_probed)


def probed(spark, sf_dir):
    return rounded(nearest_probed(labelled_vectors(spark, sf_dir), K))


def _home_wins(spark, sf_dir):
    """Market probability of a home win against what happened."""
    m = devig(contests(spark, sf_dir)).filter(F.col("p_h").isNotNull())
    won = (fo.outcome("home_goals", "away_goals") == "H").cast("int")
    return m.select(
        "match_id", "league", F.col("p_h").alias("score"), won.alias("label"),
        (fo.favourite() == "H").cast("int").alias("predicted"),
    )


def class_metrics(spark, sf_dir):
    return rounded(im.class_metrics(_home_wins(spark, sf_dir)))


def auc(spark, sf_dir):
    # Rounded scores tie often, which the ranks must handle.
    return rounded(im.auc(_home_wins(spark, sf_dir).withColumn("score", F.round("score", 4))))


def uplift(spark, sf_dir):
    df = _home_wins(spark, sf_dir).select(
        F.round("score", 4).alias("score"), (F.col("league") % 2).alias("treated"), F.col("label").alias("outcome")
    )
    return rounded(im.uplift_by_decile(df))


def churn(spark, sf_dir):
    return rounded(im.churn_table(table(spark, sf_dir, "events"), "2024-01-20", 10), 9)


def _churn_split(spark, sf_dir):
    """Train as of an earlier cutoff, test as of a later one; silence of one day counts."""
    events = table(spark, sf_dir, "events")
    train = im.churn_table(events, "2024-01-15", 1).withColumnRenamed("churned", "label")
    test = im.churn_table(events, "2024-01-20", 1).withColumnRenamed("churned", "label")
    return train, test


def classify(spark, sf_dir):
    train, test = _churn_split(spark, sf_dir)
    return rounded(im.classify(train, test, CHURN_COLUMNS).select("model", "user_id", "label", "score", "predicted"))


SCENARIOS = {
    "more_activity": {"n_events": 1.2, "value_sum": 1.2},
    "higher_value": {"value_sum": 1.1, "value_mean": 1.1},
    "recent_contact": {"recency": 0.5},
}


def scenarios(spark, sf_dir):
    train, test = _churn_split(spark, sf_dir)
    model = im.fit_classifier(train, CHURN_COLUMNS, "logistic")
    return rounded(im.scenario_grid(test, model, CHURN_COLUMNS, SCENARIOS))


QUERIES = {
    "imbalance": class_ratio,
    "nearest_neighbours": neighbours,
    "probed_neighbours": probed,
    "smote": smote,
    "smote_probed": smote_probed,
    "class_metrics": class_metrics,
    "auc": auc,
    "churn_table": churn,
    "classify": classify,
    "scenario_grid": scenarios,
    "uplift_by_decile": uplift,
}

_WINS = f"""WITH {CONTESTS}, wins AS (
  SELECT match_id, league, (1 / odds_h) / s AS p_h, (1 / odds_d) / s AS p_d, (1 / odds_a) / s AS p_a,
    (home_goals > away_goals)::int AS label
  FROM (SELECT *, 1 / odds_h + 1 / odds_d + 1 / odds_a AS s FROM contests WHERE odds_h > 1 AND odds_d > 1 AND odds_a > 1))"""



def _uniform(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('-', {', '.join(parts)}, 0)), 1, 15) AS bigint) % (1 << 30) / CAST(1 << 30 AS double))"


ORACLE = {
    "smote": f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS double[]) AS f, (label = 0)::int AS y FROM embeddings),
      s AS (SELECT greatest(count(*) FILTER (y = 0) - 1.0 * sum(y), 0) / greatest(sum(y), 1) AS per_row FROM v),
      e AS (SELECT id, f FROM v WHERE y = 1),
      d AS (SELECT a.id, b.id AS neighbour, list_distance(a.f, b.f) AS distance FROM e a JOIN e b ON a.id <> b.id),
      n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d) WHERE rank <= {K}),
      w AS (SELECT id, unnest(range(1, CAST(floor(per_row) AS bigint) + ({_uniform("id", "'more'")} < per_row - floor(per_row))::int + 1)) AS copy FROM e, s),
      p AS (SELECT w.*, 1 + CAST(floor({_uniform("id", "copy", "'pick'")} * (SELECT count(*) FROM n WHERE n.id = w.id)) AS bigint) AS rank,
        {_uniform("id", "copy", "'along'")} AS u FROM w),
      m AS (SELECT p.id, p.copy, n.neighbour, a.f AS f, b.f AS g, u, unnest(range(len(a.f))) AS dim
        FROM p JOIN n USING (id, rank) JOIN e a ON a.id = p.id JOIN e b ON b.id = n.neighbour)
      SELECT id, CAST(copy AS int) AS copy, neighbour, CAST(dim AS int) AS dim, round(f[dim + 1] + u * (g[dim + 1] - f[dim + 1]), 6) + 0.0 AS x, 1 AS label FROM m""",
    "imbalance": """WITH k AS (SELECT toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY toxic)
      SELECT count(*) AS classes, CAST(sum(n) AS bigint) AS n, max(n) AS n_majority, min(n) AS n_minority,
        round(max(n) / min(n), 6) AS ratio FROM k""",
    "nearest_neighbours": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS double[]) AS f FROM embeddings),
      d AS (SELECT a.id, b.id AS neighbour, list_distance(a.f, b.f) AS distance FROM v a JOIN v b ON a.id <> b.id)
      SELECT id, neighbour, round(distance, 6) AS distance, CAST(rank AS int) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d) WHERE rank <= 5""",
    "class_metrics": f"""{_WINS}, y AS (SELECT label = 1 AS y, p_h >= p_d AND p_h >= p_a AS p FROM wins),
      k AS (SELECT count(*) AS n, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp,
        count(*) FILTER (y AND NOT p) AS fn FROM y)
      SELECT n, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
        round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k""",
    "auc": f"""{_WINS}, r AS (SELECT label, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2) AS rk
        FROM (SELECT label, round(p_h, 4) AS s FROM wins)),
      k AS (SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
        sum(rk) FILTER (label = 1) AS rs FROM r)
      SELECT n_pos, n_neg, round((rs - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auc FROM k""",
    "churn_table": """SELECT user_id, count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS n_events,
        count(DISTINCT event_type) FILTER (ts < TIMESTAMP '2024-01-20') AS n_types,
        round(sum(value) FILTER (ts < TIMESTAMP '2024-01-20'), 9) AS value_sum,
        round(avg(value) FILTER (ts < TIMESTAMP '2024-01-20'), 9) AS value_mean,
        CAST(date_diff('day', CAST(max(ts) FILTER (ts < TIMESTAMP '2024-01-20') AS date), DATE '2024-01-20') AS bigint) AS recency,
        (count(*) FILTER (ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-30') = 0)::int AS churned
      FROM events GROUP BY user_id HAVING count(*) FILTER (ts < TIMESTAMP '2024-01-20') > 0""",
    "uplift_by_decile": f"""{_WINS}, d AS (
        SELECT league % 2 AS treated, label, CAST(floor((rank() OVER (ORDER BY round(p_h, 4)) - 1) * 10 / count(*) OVER ()) AS int) + 1 AS decile
        FROM wins)
      SELECT decile, count(*) AS n, count(*) FILTER (treated = 1) AS n_treated,
        round(avg(label) FILTER (treated = 1), 6) AS rate_treated, round(avg(label) FILTER (treated = 0), 6) AS rate_control,
        round(avg(label) FILTER (treated = 1) - avg(label) FILTER (treated = 0), 6) AS uplift
      FROM d GROUP BY decile""",
}
