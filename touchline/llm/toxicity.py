"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary texts.

A text is a sequence of expressions: lower-cased runs of letters. Both classes have
bigram and unigram counts of their own. Below them lies one shared backoff: in how
many training documents a word occurs, whichever class. Counts are discounted, and
what the discount frees goes to the level below, so an expression too rare to be
counted gets its probability from shared counts and tells the classes hardly apart.

Every expression and pair that was counted takes part, however rare or mild. The log
ratios log P(toxic) - log P(ordinary) of a text add up to four sums: of words and of
pairs, telling ones (a high ratio, in enough documents) and others, each normalised by the
text's length to the power `length_power`. How much each of these sums is worth is learned
by a logistic regression on labelled documents that the models did not count: `evidence`
is their weighted sum, and a logistic curve of it the score from 0 to 1.

Training reads every labelled document that may be learned from: three in four give the
counts, the others the weights. The models are tables and may be larger than any memory:
texts meet them in a join on their expressions. The ratios are summed as whole numbers of
1 / UNIT, so that a score does not depend on the order of the sum.

Rows: null or empty text scores as a text of no evidence; labels that are null or
not 0 or 1 are not used; without labels of both classes every score is the share of
toxic training labels (0 if there are none); repeated rows score the same; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import chunks, ids_and_texts, release, remove, stored, table
from touchline.operators.skew import checked_broadcast

EXPRESSION = re.compile(r"[^\W\d_]+")
UNIT = float(1 << 24)  # of a log ratio, of which the largest is below 64
PARTS = 4  # other words, telling words, other pairs, telling pairs
TURNS = 2  # of the pairs of all texts
RIDGE = 1.0  # on the weights of standardised sums
TOXIC_UNIT = 1 << 31  # more than the documents of a class that can be counted


@dataclass(frozen=True)
class Settings:
    least_ratio: float = 1.5  # of a telling expression's probabilities, as a logarithm
    least_gain: float = 10.0  # that ratio times the documents it was seen in
    length_power: float = 0.5
    fit_share: int = 4  # one labelled document of so many fits the curve, the others the counts
    threshold: float = 0.3


def expressions(text: str) -> list[str]:
    return EXPRESSION.findall(text.lower())


def training(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """doc_id, text, toxic, for_curve of all labelled documents that may be learned from."""
    known = labels.filter(labels["toxic"].isin(0, 1) & labels["doc_id"].isNotNull()).select(
        labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")
    )
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(learnable(F.col("doc_id")))
    curve = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(s.fit_share)) == 0
    known = checked_broadcast(stored(known.withColumn("for_curve", curve)))
    texts = ids_and_texts(docs)
    found = texts.join(known, "doc_id")
    # Texts move only if ids repeat.
    again = texts.select("doc_id").join(known, "doc_id").groupBy("doc_id").count().filter("count > 1")
    return found if again.isEmpty() else found.dropDuplicates(["doc_id"])


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == 2


def learnable(doc_id):
    return ~held_out(doc_id)


def counts(train: DataFrame) -> DataFrame:
    """n, a, b, t, o: expressions (n = 1) and pairs of neighbours (n = 2), and in how many
    toxic and ordinary documents they occur.

    A row travels as one text (a pair's words have a space between, which no expression holds)
    and one number, toxic documents times TOXIC_UNIT plus ordinary ones: a shuffled row is small."""
    target = train.sparkSession.createDataFrame([], "key string, seen long").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[str] = []
            sizes: list[int] = []
            for text in batch.column(0).to_pylist():
                words = expressions(text or "")
                before = len(keys)
                keys += set(words)
                keys += map(" ".join, set(zip(words, words[1:], strict=False)))
                sizes.append(len(keys) - before)
            if keys:
                unit = np.where(batch.column(1).to_numpy() == 1, TOXIC_UNIT, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array(np.repeat(unit, sizes), pa.int64())], names=target.names
                )

    rows = train.filter("NOT for_curve").select("text", "toxic").mapInArrow(run, target)
    parts, seen = F.split("key", " "), F.col("seen")
    pair = F.size(parts) == 2
    return rows.groupBy("key").agg(F.sum("seen").alias("seen")).select(
        F.when(pair, 2).otherwise(1).alias("n"), F.when(pair, parts[0]).otherwise("").alias("a"),
        F.when(pair, F.get(parts, F.lit(1))).otherwise(F.col("key")).alias("b"),
        F.shiftright(seen, 31).cast("double").alias("t"), seen.bitwiseAND(F.lit(TOXIC_UNIT - 1)).cast("double").alias("o"),
    )


def model(train: DataFrame, s: Settings) -> DataFrame | None:
    """Stored: key (a hash), ratio (in 1 / UNIT) and part (below PARTS) of every expression and pair that
    was counted. None without both classes.

    With D the discount, c the documents of a class that hold the word and N their sum over
    all words: P(w) = max(c - D, 0) / N + B S(w), where S(w) is the share of w in
    both classes together and B the share of all counts that the discount frees. For pairs
    likewise within their first word, with a Kneser-Ney bigram of both classes together,
    which itself backs off to S, in the place of S; a class that never counted the first word
    has that bigram alone. A document counts an expression once, so that one repetitive text
    does not decide.
    """
    wide = stored(counts(train), "zstd")
    release(train)
    sums = [
        f(c)
        for c in ("t", "o")
        for f in (
            lambda c: F.sum(c).alias(f"{c}_sum"),
            lambda c: F.count_if(F.col(c) > 0).alias(f"{c}_kinds"),
            lambda c: F.count_if(F.col(c) == 1).alias(f"{c}_once"),
            lambda c: F.count_if(F.col(c) == 2).alias(f"{c}_twice"),
        )
    ]
    total = wide.filter("n = 1").agg(*sums).first().asDict()
    if not total["t_sum"] or not total["o_sum"]:
        return None
    once, twice = total["t_once"] + total["o_once"], total["t_twice"] + total["o_twice"]
    discount = once / (once + 2 * twice) if once else 0.5
    everything = total["t_sum"] + total["o_sum"]
    # Both classes give the same weight to the shared level: a smaller class, whose
    # counts are rarer, would otherwise make every rare expression look like its own.
    back = discount * (total["t_kinds"] + total["o_kinds"]) / everything

    shared = (F.col("t") + F.col("o")) / everything

    def single(c: str):
        return F.greatest(F.col(c) - discount, F.lit(0.0)) / total[f"{c}_sum"] + back * shared

    words = stored(
        wide.filter("n = 1").select("b", "t", "o", shared.alias("shared"), F.log(single("t") / single("o")).alias("ratio"))
    )
    seen = wide.filter("n = 2")
    before = stored(
        seen.groupBy("a").agg(F.sum("t").alias("at"), F.sum("o").alias("ao"), F.count("*").alias("kinds"))
    )
    release(train)
    named = seen.select(F.xxhash64(F.concat_ws(" ", "a", "b")).alias("key"), "a", "b", "t", "o")
    joined = stored(named.join(checked_broadcast(before), "a").drop("a"), "zstd")
    remove(wide)
    release(train)
    pairs = joined.join(checked_broadcast(words.select("b", "shared")), "b")
    both, kinds = F.col("at") + F.col("ao"), F.col("kinds")
    shared_pair = (F.col("t") + F.col("o") - discount + discount * kinds * F.col("shared")) / both

    def double(c: str):
        own = F.greatest(F.col(c) - discount, F.lit(0.0)) / F.col(f"a{c}") + back * shared_pair
        return F.when(F.col(f"a{c}") > 0, own).otherwise(shared_pair)

    # Toxic documents, or as many ordinary ones in proportion, times log ratio.
    gain = F.abs("ratio") * F.when(F.col("ratio") > 0, F.col("t")).otherwise(F.col("o") * total["t_sum"] / total["o_sum"])
    telling = (F.abs("ratio") >= s.least_ratio) & (gain >= s.least_gain)
    ratio = F.round(F.col("ratio") * UNIT).cast("int").alias("ratio")

    part = telling.cast("int")
    one = words.select(F.xxhash64("b").alias("key"), ratio, part.alias("part"))
    two = pairs.withColumn("ratio", F.log(double("t") / double("o"))).select("key", ratio, (part + 2).alias("part"))
    found = stored(one.unionByName(two), "zstd")
    remove(joined)
    return found


def row():
    """Names a row by its id and text, so that rows which share an id are scored each."""
    return F.xxhash64("doc_id", "text").alias("row")


def sums_of(texts: DataFrame, known: DataFrame, power: float) -> DataFrame:
    """Stored: row, n_expressions and the sums x0, x1, ... of the parts (normalised log ratios) of
    every text that has expressions. Those that were not counted are no evidence. Words and
    pairs, these in TURNS, meet the model one after the other: fewer rows are shuffled at once."""
    target = texts.sparkSession.createDataFrame([], "row long, key string, n int").schema

    def occurring(pairs: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, held in chunks(batches):
                keys: list[str] = []
                times: list[int] = []
                sizes: list[int] = []
                for text in held:
                    words = expressions(text)
                    found = Counter(map(" ".join, zip(words, words[1:], strict=False)) if pairs else words)
                    keys += found
                    times += found.values()
                    sizes.append(len(found))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.array(rows, "int64"), sizes)), pa.array(keys, pa.string()), pa.array(times, pa.int32())],
                        names=target.names,
                    )

        found = texts.select(row(), "text").mapInArrow(run, target)
        return found.select("row", F.xxhash64("key").alias("key"), "n")

    n, zero = F.col("n").cast("long"), F.lit(0).cast("long")

    def summed(pairs: bool, turn: int = 0, turns: int = 1) -> DataFrame:
        parts = range(2, PARTS) if pairs else range(2)
        mine = F.pmod("key", F.lit(turns)) == turn
        model = known.filter(F.col("part").isin(*parts) & mine)
        met = occurring(pairs).filter(mine).join(checked_broadcast(model), "key", "inner" if pairs else "left")
        sums = [F.sum(F.when(F.col("part") == k, n * F.col("ratio")).otherwise(zero)).alias(f"x{k}") for k in parts]
        return stored(met.groupBy("row").agg(*sums, *([] if pairs else [F.sum(n).alias("n_expressions")])))

    sums = summed(False)
    release(texts)
    for turn in range(TURNS):
        more = summed(True, turn, TURNS)
        release(texts)
        columns = [F.col(f"x{k}").alias(f"x{k}_{turn}") for k in range(2, PARTS)]
        sums = sums.join(more.select("row", *columns), "row", "left")
    for k in range(2, PARTS):
        sums = sums.withColumn(f"x{k}", sum((F.coalesce(f"x{k}_{turn}", zero) for turn in range(TURNS)), zero))
    # Equal rows have met in one sum.
    equal = texts.select(row()).groupBy("row").agg(F.count("*").alias("_equal"))
    found = sums.join(equal, "row").withColumn("n_expressions", F.expr("n_expressions div _equal"))
    x = [
        (F.expr(f"x{k} div _equal") / UNIT / F.col("n_expressions") ** power).alias(f"x{k}") for k in range(PARTS)
    ]
    return stored(found.select("row", "n_expressions", *x))


def curve(points: DataFrame) -> tuple[list[float], float] | None:
    """Weight of every sum and level of the logistic regression over rows of x0, x1, ... and `toxic`,
    by Newton steps with a ridge, each one sum over the rows. None without both classes."""
    names = [f"x{k}" for k in range(PARTS)]
    whole = points.agg(F.avg("toxic").alias("mean"), *[F.stddev_pop(c).alias(c) for c in names]).first()
    mean = whole["mean"]
    if mean is None or not 0 < mean < 1:
        return None
    scale = np.array([whole[c] or 1.0 for c in names])
    w = np.append(np.zeros(PARTS), np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    ridge = np.diag([RIDGE] * PARTS + [1e-6])
    x = [F.col(c) / float(k) for c, k in zip(names, scale, strict=True)] + [F.lit(1.0)]
    upper = [(i, j) for i in range(PARTS + 1) for j in range(i, PARTS + 1)]
    for _ in range(50):
        z = sum((c * float(k) for c, k in zip(x, w, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        rows = points.select(*[c.alias(f"_{i}") for i, c in enumerate(x)], "toxic", p.alias("p"))
        v, off = F.col("p") * (1 - F.col("p")), F.col("toxic") - F.col("p")
        products = [F.sum(v * F.col(f"_{i}") * F.col(f"_{j}")) for i, j in upper]
        found = rows.agg(*products, *[F.sum(off * F.col(f"_{i}")) for i in range(PARTS + 1)]).first()
        square = np.zeros((PARTS + 1, PARTS + 1))
        for (i, j), value in zip(upper, found, strict=False):
            square[i, j] = square[j, i] = value
        step = np.linalg.solve(square + ridge, np.array(found[len(upper) :]) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return (w[:PARTS] / scale).tolist(), float(w[PARTS])


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, n_expressions of every document."""
    s = settings or Settings()
    train, texts = training(docs, labels, s), ids_and_texts(docs)
    known = model(train, s)
    share = train.agg(F.avg("toxic")).first()[0] or 0.0
    nothing = docs.sparkSession.createDataFrame([], "key long, ratio int, part int")
    release(docs)
    sums = sums_of(texts, nothing if known is None else known, s.length_power)
    x = [F.coalesce(f"x{k}", F.lit(0.0)) for k in range(PARTS)]
    fitted = None
    if known is not None:
        sample = train.filter("for_curve").select(row(), F.col("toxic").cast("long").alias("toxic")).join(sums, "row", "left")
        fitted = curve(stored(sample.select("toxic", *[c.alias(f"x{k}") for k, c in enumerate(x)])))
    weights, level = fitted or ([0.0] * PARTS, 0.0)
    # The digits that depend on the order of a sum over documents are left out.
    told = sum((c * round(w, 9) for c, w in zip(x, weights, strict=True)), F.lit(0.0))
    z = F.greatest(F.least(F.col("evidence") + round(level, 9), F.lit(700.0)), F.lit(-700.0))
    score = 1 / (1 + F.exp(-z)) if fitted else F.lit(float(share))
    found = texts.select("doc_id", row()).join(sums, "row", "left").withColumn("evidence", told).withColumn("score", score)
    return found.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= s.threshold).cast("int").alias("predicted"), "evidence",
        F.coalesce("n_expressions", F.lit(0).cast("long")).alias("n_expressions"),
    )


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
