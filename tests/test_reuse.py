"""Banded reuse test against the exact pairs, and on a large family."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import corpus, reuse


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_links_are_right_and_nearly_complete(spark, docs):
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 10_000
    for _ in range(120):  # near copies of all degrees around the limit
        base = r.choices(words, k=90)
        for _ in range(4):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((n := n + 1, " ".join(copy)))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    exact = {(x.doc_a, x.doc_b): x.jaccard for x in corpus.near_duplicates(both).collect()}
    members, links = reuse.families(both)
    family = {x.doc_id: x.family_id for x in members.collect()}
    found = {(x.early, x.late): x.jaccard for x in links.collect()}
    assert all(exact[k] == pytest.approx(v) for k, v in found.items())
    together = sum(family[a] == family[b] for a, b in exact)
    assert len(exact) > 100 and together >= 0.99 * len(exact)
    # No family joins what exact pairs do not.
    root = {i: i for i in family}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    copies = {x.doc_id: x.rep_id for x in corpus.copy_groups(both).collect()}
    for a, b in [*exact, *((d, c) for d, c in copies.items() if c is not None)]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert all(f is None or find(i) == find(f) for i, f in family.items())
    known = {x.doc_id: x.reusable for x in corpus.reuse_verdict(both).collect()}
    own = {x.doc_id: x.reusable for x in reuse.reuse_exists(both).collect()}
    assert own.keys() == known.keys() and not any(own[i] and not known[i] for i in own)
    assert sum(own.values()) >= 0.99 * sum(known.values())


def test_ten_thousand_variants_stay_linear(spark):
    n = 10_000
    words = F.transform(F.sequence(F.lit(0), F.lit(149)), lambda i: F.concat(F.lit("word"), i.cast("string")))
    family = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", words, F.concat(F.lit("variant"), F.col("id"))).alias("text")
    )
    members, links = reuse.families(family)
    assert members.filter("family_id = 0").count() == n
    assert n - 1 <= links.count() <= 2 * n
    assert reuse.reuse_exists(family).filter("reusable").count() == n


def test_sets_that_miss_the_first_of_their_names(spark, monkeypatch):
    """The earliest set of every name is far from the two that are alike."""
    r = random.Random(3)
    base = [f"a{i}" for i in range(100)]
    rows = [(i, " ".join(base[:72] + [f"x{i}y{k}" for k in range(28)])) for i in range(5)]
    near = base[:72] + [f"z{k}" for k in range(28)]
    rows += [(50, " ".join(near)), (51, " ".join([*near[:-1], "other"]))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    exact = {(x.doc_a, x.doc_b) for x in corpus.near_duplicates(df).collect()}
    assert exact == {(50, 51)}
    assert {(x.early, x.late) for x in reuse.families(df)[1].collect()} == exact


def test_rows_without_terms(spark):
    rows = [(1, None), (2, ""), (3, "... !"), (4, "same"), (5, "same"), (5, "same"), (6, "x" * 50_000 + " " + "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"name": F.lit(1), "band": F.lit(2), "rep_id": F.lit(3)})
    members, links = reuse.families(df)
    assert sorted(map(tuple, members.collect()), key=str) == [(1, None), (2, None), (3, None), (4, 4), (5, 4), (6, 6)]
    assert links.isEmpty()
    assert {x.doc_id: x.reusable for x in reuse.reuse_exists(df).collect()} == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False}
    empty = df.limit(0)
    assert reuse.families(empty)[0].isEmpty() and reuse.reuse_exists(empty).isEmpty()


def test_sets_stay_where_they_are_made(spark):
    """Names are shuffled, arrays of shingles are not, unless rows repeat."""
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l m"), (4, "..."), (None, "a b c d e f"), (None, "n o p q r s")]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    own, sets = corpus.representatives(once, 5)
    assert "hashpartitioning" not in sets._jdf.queryExecution().executedPlan().toString()
    twice = once.unionByName(once)
    for members, found in ((own, sets), corpus.representatives(twice, 5)):
        assert sorted((str(r.rep_id), len(r.shingles)) for r in found.collect()) == [("1", 2), ("2", 3), ("None", 2)]
        assert {(r.doc_id, r.rep_id) for r in members.collect()} == {(3, 1), (1, 1), (2, 2), (None, 1), (None, None)}


def test_pairs_move_only_sets_that_are_in_one(spark, monkeypatch):
    rows = [(i, f"own{i} words of the text {i} {i + 1} {i + 2}") for i in range(50)]
    rows += [(100, " ".join(map(str, range(900, 960)))), (101, " ".join(map(str, range(900, 961))))]
    asked = []
    plain = corpus.members_of
    monkeypatch.setattr(corpus, "members_of", lambda *a: asked.append(plain(*a)) or asked[-1])
    found = corpus.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r.doc_a, r.doc_b) for r in found.collect()] == [(100, 101)]
    assert {r.rep_id for r in asked[0].collect()} == {100, 101}


def test_band_names_do_not_depend_on_the_step():
    values = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, size=1000)
    least = reuse._mixed(values.view("uint64")[:, None] ^ reuse._seeds(reuse.BANDS * reuse.ROWS)).min(axis=0)
    names = np.arange(1, reuse.BANDS + 1, dtype=np.uint64)
    for column in least.reshape(reuse.BANDS, reuse.ROWS).T:
        names = reuse._mixed(names * np.uint64(0x9E3779B97F4A7C15) + column)
    assert (reuse.band_names(values) == names.view("int64")).all()


def test_partners_behind_many_others_of_their_names(spark):
    """Far texts hold all that the pair shares and precede it in every group of names."""
    base = [f"a{i}" for i in range(100)]
    rows = [(i, " ".join(base + [f"x{i}y{k}" for k in range(26)])) for i in range(800)]
    rows += [(900, " ".join([*base, "one"])), (901, " ".join([*base, "other"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x.doc_a, x.doc_b) for x in corpus.near_duplicates(df).collect()} == {(900, 901)}
    assert {x.doc_id for x in reuse.reuse_exists(df).filter("reusable").collect()} == {900, 901}
    assert {x.family_id for x in reuse.families(df)[0].filter("doc_id >= 900").collect()} == {900}


def test_links_that_no_name_gives(spark):
    """Exact without any help from names: between families, of open sets, next to a large family."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for f in range(12):
        base = r.choices(words, k=80)
        rows += [(100 * f + k, " ".join([*base[: 80 - k % 3], *(r.choice(words) for _ in range(k % 3))])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, sets = reuse.distinct_sets(df, 5)
    exact = {(x.doc_b, x.doc_a) for x in corpus.near_duplicates(df).collect()}
    none = sets.select("rep_id", F.lit("r").alias("root")).limit(0)
    assert len(exact) > 100 and {(x.late, x.early) for x in reuse.missed_links(sets, none).collect()} == exact
    roots = sets.select("rep_id", (F.col("rep_id") % 3).cast("string").alias("root"))
    found = {(x.late, x.early) for x in reuse.missed_links(sets, roots).collect()}
    assert found == {(a, b) for a, b in exact if a % 3 != b % 3}
    big = sets.select("rep_id", F.lit("r").alias("root")).filter("rep_id % 100 > 1")
    found = {(x.late, x.early) for x in reuse.missed_links(sets, big).collect()}
    assert found == {(a, b) for a, b in exact if a % 100 < 2 or b % 100 < 2}
