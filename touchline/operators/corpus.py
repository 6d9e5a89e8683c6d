"""Quality gates over a table of texts (doc_id, text). Whole texts, no prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions import text as ft
from touchline.operators.skew import checked_broadcast, pairs_within
from touchline.session import BROADCAST_ROWS, cut_lineage, setting, spread

# Word bands per register, the hard cap of a cover letter, tell-tale phrases.
BANDS = {"cover": (320, 400), "motivation": (500, 650), "job": (220, 300)}
HARD_CAP = {"cover": 450}
PHRASES = (
    "i am writing to express my interest in",
    "dear sir/madam",
)


def placeholders(docs: DataFrame) -> DataFrame:
    """Every unfilled marker of every document, with its position in the text's order."""
    return docs.select("doc_id", F.posexplode(ft.markers("text")).alias("position", "marker"))


def readiness(docs: DataFrame) -> DataFrame:
    """A document is ready if no marker is left."""
    n = F.size(ft.markers("text")).cast("long")
    return docs.select("doc_id", n.alias("n_markers"), (n == 0).alias("ready"))


def length_band(
    docs: DataFrame, bands: Mapping[str, tuple[int, int]] = BANDS, caps: Mapping[str, int] = HARD_CAP
) -> DataFrame:
    """Words per document against the band of its register."""

    def lookup(values: Mapping[str, int]):
        pairs = [F.lit(v) for item in values.items() for v in item]
        return F.element_at(F.create_map(*pairs), F.col("register"))

    n = F.col("n_words")
    low = lookup({k: v[0] for k, v in bands.items()})
    high = lookup({k: v[1] for k, v in bands.items()})
    return docs.select("doc_id", "register", F.size(ft.words("text")).alias("n_words")).withColumns(
        {
            "verdict": F.when(n < low, "short").when(n > high, "long").when(low.isNotNull(), "ok"),
            "over_cap": F.coalesce(n > lookup(caps), F.lit(False)),
        }
    )


def phrase_hits(docs: DataFrame, phrases: Sequence[str] = PHRASES) -> DataFrame:
    """(doc_id, phrase) for each tell-tale phrase a text contains. Phrases are literals: no join."""
    known = F.array(*[F.lit(p) for p in phrases])
    lowered = docs.select("doc_id", F.lower("text").alias("_text"))
    hit = F.filter(known, lambda p: F.contains(F.col("_text"), p))
    return lowered.select("doc_id", F.explode(hit).alias("phrase"))


def evidence_density(docs: DataFrame) -> DataFrame:
    """Share of sentences that carry a number; null for a text without sentences."""
    parts = docs.select("doc_id", ft.sentences("text").alias("_s"))
    n = F.size("_s").cast("long")
    evident = F.size(F.filter("_s", lambda s: s.rlike("[0-9]"))).cast("long")
    return parts.select(
        "doc_id", n.alias("n_sentences"), evident.alias("n_evident"),
        F.when(n > 0, evident / n).alias("density"),
    )


def fact_gaps(facts: DataFrame, required: DataFrame) -> DataFrame:
    """Required keys that are missing from the facts or blank there."""
    known = facts.groupBy("key").agg(
        F.max(F.when(F.trim("value") != "", F.col("value"))).alias("_value"), F.count("*").alias("_n")
    )
    return (
        required.select("key").distinct().join(known, "key", "left")
        .filter(F.col("_value").isNull())
        .select("key", F.when(F.col("_n").isNull(), "missing").otherwise("blank").alias("gap"))
    )


def fill(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """Replace markers by facts; a marker without a fact stays as it is.

    The text is split at its markers and each is looked up once: a value that itself
    holds a marker is not filled in turn. `n_unresolved` counts the markers left as they are.

    Markers travel without their texts: the values of a document come back as
    one small map, so a text is shuffled once.
    """
    known = facts.filter(F.trim("value") != "").groupBy("key").agg(F.max("value").alias("value"))
    used = docs.select("doc_id", F.explode(F.array_distinct(ft.markers("text"))).alias("key"))
    found = (
        used.join(checked_broadcast(known), "key")
        .groupBy("doc_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_facts"))
    )
    names = ft.markers("text")

    def value(name: Column) -> Column:
        return F.coalesce(F.element_at("_facts", name), F.concat(F.lit("[FILL: "), name, F.lit("]")))

    parts = F.split("text", ft.MARKER)
    filled = F.array_join(
        F.zip_with(parts, F.transform(names, value), lambda part, v: F.concat(part, F.coalesce(v, F.lit("")))), ""
    )
    out = docs.join(found, "doc_id", "left")
    known_names = F.coalesce(F.map_keys("_facts"), F.array().cast("array<string>"))
    left = F.size(F.filter(names, lambda n: ~F.array_contains(known_names, n))).cast("long")
    text = F.when(F.col("_facts").isNull(), F.col("text")).otherwise(filled).alias("text")
    columns = [text if c == "text" else F.col(c) for c in docs.columns]
    return out.select(*columns, F.coalesce(left, F.lit(0).cast("long")).alias("n_unresolved"))


def _distinct_terms(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    rows = spread(df.select(*keys, text), keys[0])
    return rows.select(*keys, F.explode(F.array_distinct(ft.terms(text))).alias("term"))


def term_containment(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Share of its target's terms that a text names.

    `docs`: doc_id, target_id, text. `targets`: target_id, target_text. Terms
    are joined on (target, term), so a target that most texts share is spread
    over its terms. A target that is missing or has no terms gives null.
    """
    wanted = _distinct_terms(targets, ["target_id"], "target_text")
    sizes = wanted.groupBy("target_id").agg(F.count("*").alias("n_terms"))
    named = _distinct_terms(docs, ["doc_id", "target_id"], "text")
    hits = (
        named.join(checked_broadcast(wanted), ["target_id", "term"])
        .groupBy("doc_id")
        .agg(F.count("*").alias("n_named"))
    )
    return (
        docs.select("doc_id", "target_id")
        .join(checked_broadcast(sizes), "target_id", "left")
        .join(hits, "doc_id", "left")
        .select(
            "doc_id", "target_id", "n_terms",
            F.when(F.col("n_terms").isNotNull(), F.coalesce("n_named", F.lit(0).cast("long"))).alias("n_named"),
        )
        .withColumn("containment", F.col("n_named") / F.col("n_terms"))
    )


def unsupported(docs: DataFrame, evidence: DataFrame, key: str = "doc_id") -> DataFrame:
    """Terms of a text that its evidence does not contain: (key, term)."""
    claimed = _distinct_terms(docs, [key], "text").distinct()
    backed = _distinct_terms(evidence, [key], "text").distinct()
    return claimed.join(backed, [key, "term"], "left_anti")


# ---- reuse test -------------------------------------------------------------


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, set_id, shingles): hashed n-term shingles; equal sets share `set_id`."""
    # The same as a set with at least one shingle, told without building it twice.
    some = docs.filter(F.col("text").rlike(ft.TERM_CHARACTER)).select("doc_id", "text")
    rows = spread(some, "doc_id")
    sets = rows.select("doc_id", F.sort_array(ft.shingle_hashes("text", n)).alias("shingles"))
    both = F.concat_ws("-", F.xxhash64("shingles"), F.xxhash64(F.reverse("shingles")))
    return sets.withColumn("set_id", both)


def copy_groups(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, rep_id): the lowest doc_id with the same shingle set; null for a text
    without terms, which is nobody's copy.

    Texts are read once and do not move further: the small (doc_id, set_id)
    table is stored, and the representative is a map-side combined minimum.
    """
    sets = cut_lineage(shingle_sets(docs, n).select("doc_id", "set_id"))
    reps = sets.groupBy("set_id").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("_n"))
    # Sets that occur once need no join, which leaves little to send around.
    repeated = checked_broadcast(reps.filter(F.col("_n") > 1).drop("_n"))
    grouped = sets.join(repeated, "set_id", "left").select(
        "doc_id", F.coalesce("rep_id", "doc_id").alias("rep_id")
    )
    blank = docs.filter(~F.coalesce(F.col("text").rlike(ft.TERM_CHARACTER), F.lit(False)))
    return grouped.unionByName(blank.select("doc_id", F.lit(None).cast(grouped.schema["rep_id"].dataType).alias("rep_id")))


def representatives(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep_id) of every text with terms, and (rep_id, shingles) of each different
    set, named by its lowest doc_id.

    Sets are stored where they are made; only their names move, to find the sets that
    occur more than once."""
    sets = cut_lineage(shingle_sets(docs, n))
    names = sets.select("doc_id", "set_id")
    reps = names.groupBy("set_id").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("_n"))
    repeated = cut_lineage(reps.filter("_n > 1"))
    few = repeated.count() <= setting(docs.sparkSession, BROADCAST_ROWS)
    repeated = F.broadcast(repeated) if few else repeated
    rep_id = F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("rep_id")).alias("rep_id")
    own = names.join(repeated, "set_id", "left").select("doc_id", rep_id)
    first = sets.join(repeated, "set_id", "left").filter(F.col("_n").isNull() | F.col("doc_id").eqNullSafe(F.col("rep_id")))
    # Sets move only if rows repeat or the names are too many to be told to all tasks.
    again = not names.groupBy("doc_id", "set_id").count().filter("count > 1").isEmpty()
    kept = (first.dropDuplicates(["set_id"]) if again else first).select(rep_id, "shingles")
    return own, kept if few and not again else cut_lineage(kept)


def members_of(pairs: DataFrame, a: str, b: str, sets: DataFrame) -> DataFrame:
    """The sets that are in a pair, if these are few enough to be told to all tasks; else all."""
    wanted = cut_lineage(pairs.select(F.explode(F.array(a, b)).alias("rep_id")).distinct())
    few = wanted.count() <= setting(pairs.sparkSession, BROADCAST_ROWS)
    return sets.join(F.broadcast(wanted), "rep_id", "left_semi") if few else sets


def near_duplicates(docs: DataFrame, n: int = 5, tau: float = 0.8) -> DataFrame:
    """All pairs of different shingle sets with Jaccard similarity >= tau, exactly.

    Each set is named by its lowest doc_id; `copy_groups` gives the documents
    behind it, so a text that was copied a million times makes no pairs of its
    own. Candidates come from prefix filtering: with shingles ordered from rare
    to common, two sets that similar share one of the first
    |s| - ceil(tau |s|) + 1. Common passages are thus never compared on. The
    remaining hot shingles are split by `pairs_within`.
    """
    _, distinct = representatives(docs, n)
    distinct = distinct.withColumn("size", F.size("shingles"))

    # Counting and choosing share one shuffle. Shingles of one set only come first in
    # its order and cannot make a pair: they fill the prefix but need not be sorted or sent.
    exploded = distinct.select("rep_id", "size", F.explode("shingles").alias("shingle"))
    counted = exploded.withColumn("df", F.count("*").over(W.partitionBy("shingle")))
    ranked = (
        counted.filter("df > 1")
        .groupBy("rep_id", "size")
        .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("ordered"))
    )
    needed = F.ceil(F.col("size") * F.lit(tau) - F.lit(1e-9)).cast("int")
    slots = F.greatest(F.size("ordered") - needed + 1, F.lit(0))
    posted = cut_lineage(
        ranked.select("rep_id", "size", F.explode(F.slice("ordered", F.lit(1), slots)).alias("_p")).select(
            F.col("_p.shingle").alias("shingle"), F.col("rep_id").alias("doc"), "size"
        )
    )
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    candidates = cut_lineage(
        pairs_within(posted, ["shingle"], "doc")
        .filter(small >= large * F.lit(tau) - F.lit(1e-9))
        .select("doc_a", "doc_b")
        .distinct()
    )
    held = members_of(candidates, "doc_a", "doc_b", distinct)
    a = held.select(F.col("rep_id").alias("doc_a"), F.col("shingles").alias("_a"))
    b = held.select(F.col("rep_id").alias("doc_b"), F.col("shingles").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    jaccard = shared / (F.size("_a") + F.size("_b") - shared)
    return (
        candidates.join(a, "doc_a")
        .join(b, "doc_b")
        .select("doc_a", "doc_b", jaccard.alias("jaccard"))
        .filter(F.col("jaccard") >= tau)
    )


def reuse_verdict(docs: DataFrame, n: int = 5, tau: float = 0.8) -> DataFrame:
    """Could this text serve elsewhere unchanged? True if a copy or near copy exists."""
    groups = copy_groups(docs, n)
    sizes = groups.groupBy("rep_id").agg(F.count("*").alias("n_copies"))
    pairs = near_duplicates(docs, n, tau)
    near = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("rep_id")).groupBy("rep_id").agg(
        F.count("*").alias("n_near")
    )
    per_set = sizes.join(near, "rep_id", "left").select(
        "rep_id", (F.col("n_copies") - 1).alias("n_copies"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )
    copies, near = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n_copies", "n_near"))
    return groups.join(per_set, "rep_id", "left").select(
        "doc_id", copies.alias("n_copies"), near.alias("n_near"), ((copies > 0) | (near > 0)).alias("reusable")
    )
