"""Reuse test without quadratic families: banded MinHash, then exact search of what it leaves.

Every set of shingles gets BANDS names, each from ROWS minima, and meets the earliest
set of each. That settles large families in work and rows that grow with the number of
sets. What names leave open is then found exactly, by prefix filtering: all links
between sets that are not yet in one family (`families`), or with a set that has no
link yet (`reuse_exists`). Links are verified exactly, so none is wrong and no verdict
or family misses one; links inside a family are not all listed.

Rows: texts without terms are nobody's copy; null texts likewise; repeated rows count
once, and an id with different texts has a row per text in `families`; empty tables
give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.corpus import members_of, representatives
from touchline.operators.skew import checked_broadcast, pairs_within
from touchline.session import cut_lineage

BANDS, ROWS = 24, 5
STEP = 256  # shingles hashed together: the matrix of all their hashes stays in the cache


@lru_cache(maxsize=4)
def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, size=n, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _mixed_in_place(x: np.ndarray) -> np.ndarray:
    """`_mixed`, with one matrix besides `x`."""
    over = np.empty_like(x)
    for shift, factor in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D), (33, 1)):
        np.right_shift(x, np.uint64(shift), out=over)
        np.bitwise_xor(x, over, out=x)
        if factor > 1:
            np.multiply(x, np.uint64(factor), out=x)
    return x


def band_names(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The names of one set, as signed longs."""
    seeds = _seeds(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    values = shingles.astype("int64").view("uint64")
    for start in range(0, len(values), STEP):
        part = values[start : start + STEP, None] ^ seeds
        np.minimum(least, _mixed_in_place(part).min(axis=0), out=least)
    names = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        names = _mixed(names * np.uint64(0x9E3779B97F4A7C15) + column)
    return names.view("int64")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sets = batch.column("rep_id"), batch.column("shingles")
        names = [band_names(s.values.to_numpy(zero_copy_only=False)) for s in sets]
        for band in range(BANDS if names else 0):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.full(len(names), band, "int32")), pa.array(np.array([n[band] for n in names]))],
                names=["rep_id", "band", "name"],
            )


def distinct_sets(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep_id) of every text with terms, and (rep_id, shingles) of every different set."""
    own, sets = representatives(docs, n)
    return own.distinct(), sets


def _verified(pairs: DataFrame, sets: DataFrame, tau: float) -> DataFrame:
    """The pairs (late, early) that are similar enough, with their Jaccard similarity."""
    pairs = cut_lineage(pairs)
    sets = members_of(pairs, "late", "early", sets)
    sized = pairs.join(sets.select(F.col("rep_id").alias("late"), F.col("shingles").alias("_a")), "late")
    both = sized.join(sets.select(F.col("rep_id").alias("early"), F.col("shingles").alias("_b")), "early")
    shared = F.size(F.array_intersect("_a", "_b"))
    jaccard = shared / (F.size("_a") + F.size("_b") - shared)
    return both.select("late", "early", jaccard.alias("jaccard")).filter(F.col("jaccard") >= tau)


def banded_links(sets: DataFrame, tau: float = 0.8) -> DataFrame:
    """late, early, jaccard: verified links of sets to the earliest of their names, linear in the
    sets. `missed_links` finds what these leave."""
    key = dict(sets.dtypes)["rep_id"]
    names = cut_lineage(sets.select("rep_id", "shingles").mapInArrow(_named, f"rep_id {key}, band int, name long"))
    groups = names.groupBy("band", "name").agg(F.min("rep_id").alias("early"), F.count("*").alias("_n"))
    groups = cut_lineage(groups.filter("_n > 1"))
    shared = names.join(checked_broadcast(groups), ["band", "name"])
    first = shared.filter("rep_id > early").select(F.col("rep_id").alias("late"), "early").distinct()
    return cut_lineage(_verified(first, sets, tau))


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("late", "early")).alias("rep_id")).distinct()


def missed_links(sets: DataFrame, roots: DataFrame, tau: float = 0.8) -> DataFrame:
    """late, early, jaccard: every link of two sets whose roots differ, exactly.

    `roots` has rep_id and root; a set without a row there is a root of its own. Candidates
    come from prefix filtering as in `near_duplicates`. Shingles that occur under one root
    only come first in the order of all sets: they cannot join two roots, so they fill the
    prefix and are not sent. What a family shares with itself alone costs nothing here.
    """
    own = F.xxhash64(F.lit("set"), "rep_id")
    known = roots.select("rep_id", F.xxhash64(F.lit("root"), "root").alias("root"))
    sized = sets.filter("rep_id IS NOT NULL").join(checked_broadcast(known), "rep_id", "left").select(
        "rep_id", F.coalesce("root", own).alias("root"), F.xxhash64("shingles").alias("_set"), F.size("shingles").alias("size"), "shingles"
    )
    exploded = sized.select("rep_id", "root", "_set", "size", F.explode("shingles").alias("shingle"))
    within = W.partitionBy("shingle")
    counted = exploded.withColumns(
        {"df": F.count("*").over(within), "_least": F.min("root").over(within), "_most": F.max("root").over(within)}
    )
    ranked = (
        counted.filter("_least <> _most")
        .groupBy("rep_id", "root", "_set", "size")
        .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("ordered"))
    )
    needed = F.ceil(F.col("size") * F.lit(tau) - F.lit(1e-9)).cast("int")
    slots = F.greatest(F.size("ordered") - needed + 1, F.lit(0))
    posted = cut_lineage(
        ranked.select("rep_id", "root", "size", F.explode(F.slice("ordered", F.lit(1), slots)).alias("_p"))
        .select(F.col("_p.shingle").alias("shingle"), "rep_id", "root", "size")
    )
    # The largest root of a shingle need not meet itself: only who is outside of it meets all.
    per_root = posted.groupBy("shingle", "root").agg(F.count("*").alias("_n"))
    main = per_root.groupBy("shingle").agg(F.max(F.struct("_n", "root"))["root"].alias("_main"), F.count("*").alias("_roots"))
    split = cut_lineage(posted.join(main.filter("_roots > 1").drop("_roots"), "shingle"))
    outside, inside = (split.filter(c).drop("_main") for c in ("root <> _main", "root = _main"))
    at = [F.col(c).alias(f"{c}_b") for c in ("rep_id", "root", "size")]
    met = outside.select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("rep_id", "root", "size")]).join(
        inside.select("shingle", *at), "shingle"
    )
    both = pairs_within(outside, ["shingle"], "rep_id").filter("root_a <> root_b").select(*met.columns).unionByName(met)
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    pairs = both.filter((small >= large * F.lit(tau) - F.lit(1e-9)) & (F.col("rep_id_a") != F.col("rep_id_b"))).select(
        F.greatest("rep_id_a", "rep_id_b").alias("late"), F.least("rep_id_a", "rep_id_b").alias("early")
    )
    return cut_lineage(_verified(pairs.distinct(), sets, tau))


def connected(links: DataFrame) -> DataFrame:
    """rep_id, root: the least rep_id that links connect a set with, of all sets in a link."""
    ways = cut_lineage(links.select(F.inline(F.array(
        F.struct(F.col("late").alias("a"), F.col("early").alias("b")), F.struct(F.col("early").alias("a"), F.col("late").alias("b")),
    ))))
    state = cut_lineage(ways.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        # The least root next door, then that root's own root: long chains halve.
        offered = ways.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("_r"))
        near = state.join(offered, F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", "_r").alias("_r"))
        above = state.select(F.col("node").alias("_r"), F.col("root").alias("_up"))
        turned = cut_lineage(near.join(above, "_r", "left").select("node", F.col("root").alias("_was"), F.least("_r", "_up").alias("root")))
        state = turned.select("node", "root")
        if turned.filter("_was <> root").isEmpty():
            return state.withColumnRenamed("node", "rep_id")


def families(docs: DataFrame, n: int = 5, tau: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, family_id) and the links between different texts (late, early,
    jaccard). A family holds what links connect; its id is its smallest doc_id. A text
    without terms has a null family."""
    own, sets = distinct_sets(docs, n)
    links = banded_links(sets, tau)
    more = missed_links(sets, connected(links), tau)
    links = links.unionByName(more)
    state = connected(links).withColumnRenamed("rep_id", "node")
    found = own.join(checked_broadcast(state), F.col("rep_id") == F.col("node"), "left")
    member = found.select("doc_id", F.coalesce("root", "rep_id").alias("family_id"))
    blank = docs.select("doc_id").distinct().join(own.select("doc_id"), "doc_id", "left_anti")
    return member.unionByName(blank.withColumn("family_id", F.lit(None).cast(member.schema["family_id"].dataType))), links


def reuse_exists(docs: DataFrame, n: int = 5, tau: float = 0.8) -> DataFrame:
    """doc_id, reusable: whether any copy or near copy exists. Nothing is counted, so no
    family is ever listed pair by pair."""
    own, sets = distinct_sets(docs, n)
    copied = own.groupBy("rep_id").agg((F.count("*") > 1).alias("_copied"))
    links = banded_links(sets, tau)
    settled = _ends(links)
    # Who has a link is settled and need not meet its like; everybody else meets all.
    more = missed_links(sets, settled.withColumn("root", F.lit("settled")), tau)
    linked = _ends(links.unionByName(more))
    per_set = copied.join(linked.withColumn("_near", F.lit(True)), "rep_id", "left")
    verdict = F.col("_copied") | F.coalesce("_near", F.lit(False))
    judged = own.join(per_set.select("rep_id", verdict.alias("reusable")), "rep_id")
    judged = judged.groupBy("doc_id").agg(F.max("reusable").alias("reusable"))
    everyone = docs.select("doc_id").distinct()
    return everyone.join(judged, "doc_id", "left").select("doc_id", F.coalesce("reusable", F.lit(False)).alias("reusable"))
