"""Imbalanced learning on large labelled tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.draws import drawn
from touchline.operators.neighbours import nearest
from touchline.operators.skew import checked_broadcast, totals_before
from touchline.session import cut_lineage


def class_weight(df: DataFrame, label: str, name: str = "class_weight") -> DataFrame:
    """Cost-sensitive weight N / (K n_k) of each row's class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    everything = W.partitionBy()  # over one row per class
    weights = counts.select(
        label,
        (F.sum("_n").over(everything) / (F.count("*").over(everything) * F.col("_n"))).alias(name),
    )
    return df.join(checked_broadcast(weights), label, "left").select(*df.columns, name)


def imbalance(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("classes"),
        F.sum("n").alias("n"),
        F.max("n").alias("n_majority"),
        F.min("n").alias("n_minority"),
        (F.max("n") / F.min("n")).alias("ratio"),
    )


def smote(
    df: DataFrame,
    k: int = 5,
    ratio: float = 1.0,
    seed: int = 0,
    search: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Synthetic minority rows between a row and one of its k nearest minority rows.

    `df`: id long, features array<double>, label 0/1, training rows only. Makes
    about `ratio` * majority - minority rows. Which neighbour and how far along
    the line are hashes of (id, copy, seed), so a recomputed task gives the
    same rows. `search` finds the neighbours, by default exactly; for a large
    minority in many dimensions `probing.nearest_probed` does.
    """
    sizes = df.agg(
        F.sum("label").alias("minority"), F.count("*").alias("n")
    ).first()
    minority_rows = int(sizes["minority"] or 0)
    per_row = max(ratio * (sizes["n"] - minority_rows) - minority_rows, 0.0) / max(minority_rows, 1)
    minority = df.filter("label = 1").select("id", "features")

    def uniform(*parts) -> F.Column:
        return F.pmod(drawn(*parts, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    whole, rest = int(per_row), per_row - int(per_row)
    copies = F.lit(whole) + (uniform("id", F.lit("more")) < rest).cast("int")
    wanted = minority.withColumn(
        "copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))
    )
    graph = cut_lineage(search(minority, k) if search else nearest(minority, k, seed))
    known = graph.groupBy("id").agg(F.max("rank").alias("_known"))
    picked = wanted.join(known, "id").withColumn(
        "rank", (F.floor(uniform("id", "copy", F.lit("pick")) * F.col("_known")) + 1).cast("int")
    )
    ends = minority.select(F.col("id").alias("neighbour"), F.col("features").alias("_to"))
    along = F.zip_with("features", "_to", lambda a, b: a + F.col("_u") * (b - a))
    return (
        picked.join(graph, ["id", "rank"])
        .join(ends, "neighbour")
        .withColumn("_u", uniform("id", "copy", F.lit("along")))
        .select("id", "copy", "neighbour", along.alias("features"), F.lit(1).alias("label"))
    )


def class_metrics(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Recall, precision and F1 of the positive (minority) class."""
    y, p = F.col(label) == 1, F.col(predicted) == 1

    def count(c):
        return F.sum(c.cast("long"))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        scored.agg(
            F.count("*").alias("n"), count(y & p).alias("tp"), count(~y & p).alias("fp"),
            count(y & ~p).alias("fn"),
        )
        .withColumns({"recall": F.try_divide(tp, tp + fn), "precision": F.try_divide(tp, tp + fp)})
        .withColumn("f1", F.try_divide(2 * tp, 2 * tp + fp + fn))
    )


def _with_score(df: DataFrame, score: str) -> DataFrame:
    value = F.col(score).cast("double")
    return df.filter(value.isNotNull() & ~F.isnan(value))


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """ROC AUC by ranks; tied scores count one half. Rows without a score (null or NaN)
    have no rank and do not count.

    Rows are counted per score first; ranks come from sums over those counts.
    """
    counts = _with_score(scored, score).groupBy(F.col(score).cast("double").alias("_score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) == 0).cast("long")).alias("neg"),
    )
    ranked = totals_before(counts, "_score", ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return ranked.agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"),
    )


def churn_table(events: DataFrame, cutoff: str, horizon_days: int) -> DataFrame:
    """Activity per user strictly before the cutoff; churned if silent in the horizon.

    One aggregation by user; the two sides of the cutoff never mix.
    """
    at = F.lit(cutoff).cast("timestamp_ntz")
    end = at + F.expr(f"INTERVAL {int(horizon_days)} DAYS")
    ts = F.col("ts").cast("timestamp_ntz")
    past = ts < at
    ahead = (ts >= at) & (ts < end)
    return (
        events.filter(ts < end)
        .groupBy("user_id")
        .agg(
            F.sum(past.cast("long")).alias("n_events"),
            F.count_distinct(F.when(past, F.col("event_type"))).alias("n_types"),
            F.sum(F.when(past, F.col("value"))).alias("value_sum"),
            F.avg(F.when(past, F.col("value"))).alias("value_mean"),
            F.datediff(F.lit(cutoff).cast("date"), F.max(F.when(past, F.col("ts")))).cast("long").alias("recency"),
            (F.sum(ahead.cast("long")) == 0).cast("int").alias("churned"),
        )
        .filter(F.col("n_events") > 0)
    )


CLASSIFIERS = ("svm", "logistic", "forest")


def _learner(kind: str, weight: str, seed: int):
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": weight}
    if kind == "svm":
        return LinearSVC(maxIter=10, regParam=0.01, **common)
    if kind == "logistic":
        return LogisticRegression(maxIter=20, regParam=0.01, **common)
    return RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, **common)


def fit_classifier(train: DataFrame, columns: Sequence[str], kind: str, seed: int = 0) -> PipelineModel:
    """Imputer, scaler and classifier, all fitted on the training rows, classes weighted."""
    filled = [f"{c}_filled" for c in columns]
    stages = [
        Imputer(inputCols=list(columns), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
        _learner(kind, "class_weight", seed),
    ]
    as_double = {c: F.col(c).cast("double") for c in columns}
    return Pipeline(stages=stages).fit(class_weight(train.withColumns(as_double), "label"))


def score_classifier(model: Model, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds `score` (probability, or margin for the SVM) and `predicted`."""
    out = model.transform(df.withColumns({c: F.col(c).cast("double") for c in columns}))
    raw = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumns(
        {"score": vector_to_array(raw)[1], "predicted": F.col("prediction").cast("int")}
    ).select(*df.columns, "score", "predicted")


def classify(train: DataFrame, test: DataFrame, columns: Sequence[str], kinds: Sequence[str] = CLASSIFIERS) -> DataFrame:
    """Test rows scored by each classifier, long by `model`."""
    out = None
    train = cut_lineage(train)  # read once per pass of each fit
    for kind in kinds:
        scored = score_classifier(fit_classifier(train, columns, kind), test, columns)
        scored = scored.withColumn("model", F.lit(kind))
        out = scored if out is None else out.unionByName(scored)
    return out


Scenarios = Mapping[str, Mapping[str, float]]


def scenario_grid(df: DataFrame, model: Model, columns: Sequence[str], scenarios: Scenarios) -> DataFrame:
    """Rescore each record under each intervention; mean shift against `as_is`.

    A scenario multiplies columns by factors. Scenarios are literals on the
    row, so the grid needs no join.
    """
    grid = {"as_is": {}, **scenarios}
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                *[F.lit(float(factors.get(c, 1.0))).alias(f"_x_{c}") for c in columns],
            )
            for name, factors in grid.items()
        ]
    )
    rows = df.select("*", F.inline(entries))
    rows = rows.withColumns({c: F.col(c).cast("double") * F.col(f"_x_{c}") for c in columns})
    means = (
        score_classifier(model, rows, columns)
        .groupBy("scenario")
        .agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    )
    base = F.max(F.when(F.col("scenario") == "as_is", F.col("mean_score"))).over(W.partitionBy())
    return means.withColumn("shift", F.col("mean_score") - base)  # one row per scenario


def uplift_by_decile(df: DataFrame, score: str = "score") -> DataFrame:
    """Treated minus control rate by score decile (columns treated 0/1, outcome 0/1).

    A row's decile is that of the share of rows with a lower score, so equal
    scores stay together and no tie has to be broken. Rows without a score (null or
    NaN) have no decile and do not count.
    """
    df = _with_score(df, score)
    treated = F.col("treated") == 1
    y = F.col("outcome").cast("long")
    zero = F.lit(0)
    per_score = df.groupBy(F.col(score).cast("double").alias("_score")).agg(
        F.count("*").alias("n"),
        F.sum(treated.cast("long")).alias("n_treated"),
        F.sum(F.when(treated, y).otherwise(zero)).alias("y_treated"),
        F.sum(F.when(treated, zero).otherwise(y)).alias("y_control"),
    )
    total = df.count()
    ranked = totals_before(per_score, "_score", ["n"])
    decile = (F.floor(F.col("n_before") * 10 / F.lit(total)) + 1).cast("int")
    sums = ranked.groupBy(decile.alias("decile")).agg(
        F.sum("n").alias("n"), F.sum("n_treated").alias("n_treated"),
        F.sum("y_treated").alias("_yt"), F.sum("y_control").alias("_yc"),
    )
    rate_treated = F.try_divide(F.col("_yt"), F.col("n_treated"))
    rate_control = F.try_divide(F.col("_yc"), F.col("n") - F.col("n_treated"))
    return sums.select(
        "decile", "n", "n_treated", rate_treated.alias("rate_treated"),
        rate_control.alias("rate_control"), (rate_treated - rate_control).alias("uplift"),
    )
