"""How filters interact: what each removes, alone and behind the others, in every order.

Five failure conditions, each a bit: A under `min_words` words; B fewer than
`min_distinct` percent distinct words; C more than `max_capitals` percent capitals;
D any character of `forbidden`; E the text equals that of a smaller doc_id.

A to D come from the text itself. E is an existential self-join: documents are
left-semi joined on (hash, exact text) with the earliest document of every
repeated text, on the condition that its doc_id is smaller. The ids that the join
leaves are united with the other failures, and one aggregation per document
gives its combination of bits. All orders of the filters follow from the number
of documents per part and combination, of which there are at most 32 per part.

Only texts whose hash occurs twice are moved, and copies of one text are spread
over tasks: the earliest one, of which there is a row per text, is sent to each.

Rows: null text is empty and an empty text fails A alone (and E behind an equal
one); null part is ''; a null doc_id has no smaller one, is smaller than none and
has no labels; rows with the same doc_id and text are all counted and are no
copies of each other; repeated labels of a doc_id count as good or toxic if any of
them says so; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import WORD_BREAK, stored, table
from touchline.llm.copies import among, repeated, text_hash
from touchline.llm.quality import bind

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}


@dataclass(frozen=True)
class Limits:
    min_words: int = 100
    min_distinct: int = 80
    max_capitals: int = 10
    forbidden: str = "[#$%&*|]"


def own_failures(text: Column, limits: Limits) -> Column:
    """Bits A to D of a text."""

    def of_words(words: Column) -> Column:
        distinct = F.size(F.array_distinct(words))
        return F.when(F.size(words) < limits.min_words, BIT["A"]).otherwise(0) + F.when(
            100 * distinct < limits.min_distinct * F.size(words), BIT["B"]
        ).otherwise(0)

    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (
        bind(words, of_words)
        + F.when(100 * capitals.cast("long") > limits.max_capitals * F.length(text), BIT["C"]).otherwise(0)
        + F.when(text.rlike(limits.forbidden), BIT["D"]).otherwise(0)
    )


def later_copies(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, text, hash and others) whose text a smaller doc_id holds."""
    known = rows.filter(F.col("doc_id").isNotNull())
    copies = among(known, repeated(known.select("hash"), ["hash"]), ["hash"])
    first = copies.groupBy("hash", "text", "n_parts").agg(F.min("doc_id").alias("_first"))
    sent = first.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    spread = copies.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.col("n_parts")).cast("int"))
    left, right = spread.alias("l"), sent.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("hash", "text", "_part")]
    smaller = F.col("r._first") < F.col("l.doc_id")
    return left.join(right, [*same, smaller], "left_semi").select("doc_id", "hash", "part")


def failures(docs: DataFrame, limits: Limits | None = None, part: str = "lang") -> DataFrame:
    """doc_id, part, mask (the bits of the failed filters) and n, the rows it stands for."""
    limits = limits or Limits()
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    name = F.coalesce(docs[part].cast("string"), F.lit("")) if part in docs.columns else F.lit("")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), text_hash(text).alias("hash"), name.alias("part")
    )
    own = stored(rows.select("doc_id", "hash", "part", own_failures(F.col("text"), limits).alias("mask"), F.lit(1).alias("n")))
    later = later_copies(rows).withColumns({"mask": F.lit(BIT["E"]), "n": F.lit(0)})
    united = own.filter("doc_id IS NOT NULL").unionByName(later)
    bits = united.groupBy("doc_id", "hash", "part").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))
    without_id = own.filter("doc_id IS NULL").groupBy("doc_id", "hash", "part", "mask").agg(F.sum("n").alias("n"))
    columns = ("doc_id", "part", "mask", "n")
    return bits.select(*columns).unionByName(without_id.select(*columns))


def combinations(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and mask: the documents, and how many of them are labelled good and toxic."""
    known = labels.filter(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("_id")).agg(
        F.max((labels["quality"] == 1).cast("int")).alias("_good"),
        F.max((labels["toxic"] == 1).cast("int")).alias("_toxic"),
    )
    labelled = failed.join(known, F.col("doc_id") == F.col("_id"), "left")
    of = lambda flag: F.sum(F.col("n") * F.coalesce(flag, F.lit(0)))
    return labelled.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), of(F.col("_good")).alias("n_good"), of(F.col("_toxic")).alias("n_toxic")
    )


def steps() -> Column:
    """Every step of every order: its filter's bit and the bits of the filters before it."""
    rows = []
    for order in permutations(FILTERS):
        for at, name in enumerate(order):
            earlier = sum(BIT[f] for f in order[:at])
            rows.append(f"struct('{''.join(order)}' filter_order, {at + 1} step, {BIT[name]} bit, {earlier} earlier)")
    return F.expr(f"array({', '.join(rows)})")


def every_order(counts: DataFrame) -> DataFrame:
    """From the counts per combination: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley for every part, order and step."""
    mask = F.col("mask")
    at = counts.select("*", F.explode(steps()).alias("_s")).select("*", "_s.*")
    fails, failed_before = mask.bitwiseAND(F.col("bit")) != 0, mask.bitwiseAND(F.col("earlier")) != 0
    survives = ~fails & ~failed_before
    removed = fails & ~failed_before
    total = lambda when, n="n": F.sum(F.when(when, F.col(n)).otherwise(0))
    rows = at.groupBy("part", "filter_order", "step", "bit").agg(
        total(survives).alias("kept"),
        total(removed).alias("removed"),
        total(fails & failed_before).alias("redundant"),
        total(mask == F.col("bit")).alias("unique_fails"),
        total(removed, "n_good").alias("good_lost"),
        total(removed, "n_toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(W.partitionBy("part", "bit"))
    return rows.withColumn("shapley", shapley).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame, limits: Limits | None = None, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step."""
    return every_order(combinations(failures(docs, limits, part), labels))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS lowest FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS tox
      FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(tox, 0) AS tox, list_concat(
        CASE WHEN len(ws) < 100 THEN ['A'] ELSE [] END,
        CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN ['B'] ELSE [] END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN ['C'] ELSE [] END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN ['D'] ELSE [] END,
        CASE WHEN lowest < doc_id THEN ['E'] ELSE [] END) AS failed
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS n_good, sum(tox) AS n_tox FROM f GROUP BY ALL),
x(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT array_to_string(ks, '') AS filter_order, step, ks[step] AS k, ks[1:step - 1] AS earlier
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
j AS (SELECT part, filter_order, step, k, n, n_good, n_tox, failed, list_contains(failed, k) AS fails,
             list_has_any(failed, earlier) AS before FROM c, s),
g AS (SELECT part, filter_order, step, k,
             sum(CASE WHEN NOT fails AND NOT before THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN fails AND NOT before THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN fails AND before THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails AND len(failed) = 1 THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN fails AND NOT before THEN n_good ELSE 0 END) AS good_lost,
             sum(CASE WHEN fails AND NOT before THEN n_tox ELSE 0 END) AS toxic_lost
      FROM j GROUP BY ALL)
SELECT part, filter_order, CAST(step AS integer) AS step, CAST(kept AS bigint) AS kept, CAST(removed AS bigint) AS removed,
       CAST(redundant AS bigint) AS redundant, CAST(unique_fails AS bigint) AS unique_fails,
       CAST(good_lost AS bigint) AS good_lost, CAST(toxic_lost AS bigint) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS bigint) AS shapley
FROM g
"""
