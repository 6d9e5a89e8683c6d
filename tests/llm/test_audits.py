"""Source divergence, filter interaction and sentence pieces."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from touchline.llm import copies, divergence, filter_audit, queries, sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 7919} and{i % 31}" for i in range(30_000))
SHOUT = " ".join(["LOUD"] * 120)
EDGES = [
    (0, None, "en"), (1, "", "en"), (2, " \t\n\r\x0b\x0c ", None), (3, "a", "fr"), (4, LONG, "en"), (9, LONG, "de"),
    (5, "same words", "en"), (5, "same words", "en"), (5, "other words # here", "en"), (6, "same words", None),
    (None, "same words", "en"), (None, None, None), (7, SHOUT, "fr"), (8, SHOUT + " x", "fr"), (10, SHOUT, "fr"),
    (11, "naïve 日本語 🙂 don't\r\n\x1cx ▁ _", ""),
]
CLASHING = "hash string, part string, mask string, n int, step string, _id int, n_parts string"


@pytest.fixture(scope="module")
def edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string, lang string").withColumn("source", F.lit(None).cast("string"))
    return df.withColumns({c.split()[0]: F.lit(1).cast(c.split()[1]) for c in CLASHING.split(", ")})


def against_sql(rows, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    expected = found.fetchall()
    own = [tuple(r[c] for c in columns) for r in rows]
    assert sorted(own, key=repr) == sorted(expected, key=repr)
    return own


# ---- filter audit -----------------------------------------------------------


@pytest.fixture(scope="module")
def edge_labels(spark):
    rows = [(4, 1, 0), (9, 1, 1), (5, None, 1), (5, 1, 0), (10, 0, 1), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_audit_of_nulls_copies_and_repeated_rows(edges, edge_labels):
    rows = filter_audit.filter_audit(edges, edge_labels).collect()
    plain = edges.select("doc_id", "text", "lang", "source")
    against_sql(rows, queries.ORACLE["op12_filter_audit"], documents=plain, labels=edge_labels)
    assert len(rows) == 600 * len({r[2] or "" for r in EDGES})
    assert filter_audit.filter_audit(edges.limit(0), edge_labels).count() == 0
    assert filter_audit.filter_audit(edges, edge_labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_of_documents(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = queries.QUERIES["op12_filter_audit"](spark, sf_dir).collect()
    against_sql(rows, queries.ORACLE["op12_filter_audit"], documents=read("documents"), labels=read("labels"))


def test_orders_by_brute_force(spark):
    r = random.Random(3)
    masks = Counter(r.randrange(32) for _ in range(500))
    counts = spark.createDataFrame([("", m, n, 0, 0) for m, n in masks.items()], "part string, mask int, n long, n_good long, n_toxic long")
    found = {(x.filter_order, x.step): x for x in filter_audit.every_order(counts).collect()}
    worth = Counter()
    for order in permutations("ABCDE"):
        left = dict(masks)
        for step, name in enumerate(order, 1):
            bit = filter_audit.BIT[name]
            gone = sum(n for m, n in left.items() if m & bit)
            left = {m: n for m, n in left.items() if not m & bit}
            x = found["".join(order), step]
            assert (x.removed, x.kept) == (gone, sum(left.values()))
            assert x.removed + x.redundant == sum(n for m, n in masks.items() if m & bit)
            assert x.unique_fails == masks[bit]
            worth[name] += gone
    assert all(found[o, s].shapley == worth[o[s - 1]] for o, s in found)


def test_a_third_of_the_rows_are_copies(spark, monkeypatch):
    monkeypatch.setattr(copies, "PART_ROWS", 10)
    docs = spark.range(600).select(
        (F.col("id") * 7 % 601).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("one text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"),
        F.lit("en").alias("lang"),
    )
    failed = filter_audit.failures(docs).filter(F.col("mask").bitwiseAND(filter_audit.BIT["E"]) != 0)
    copies_of = docs.filter("text = 'one text'")
    assert failed.count() == copies_of.count() - 1
    least = copies_of.agg(F.min("doc_id")).first()[0]
    assert failed.filter(F.col("doc_id") == least).isEmpty()


# ---- source divergence ------------------------------------------------------


def sources_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_divergence_of_edge_rows(spark, edges, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 3)
    r = random.Random(2)
    words = ["Mill", "mill", "río", "naïve", "日本", "a", "don't", "x1y", "__", "Éa", "MILL", "tail"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 9))), r.choice(["en", "fr", None]), r.choice("stuvwxyz")) for i in range(80)]
    rows += [(200 + i, "one copied text of the mill", "en", "s" if i % 3 else "t") for i in range(40)]
    rows += [(300, None, "xx", "a"), (301, "once", "xx", None), (302, "", "xx", "b"), (303, "mill", "yy", "alone")]
    docs = sources_of(spark, rows)
    found = against_sql(divergence.divergence(docs).collect(), queries.ORACLE["op11_source_divergence"], documents=docs)
    assert {x[4] for x in found if x[0] == "xx"} == {0}  # no kept term: only pairs of value 0
    assert divergence.divergence(docs.limit(0)).count() == 0
    clashing = edges.withColumns({"term": F.lit("t"), "i": F.lit(1), "by": F.lit(2), "sources": F.lit(3), "raw": F.lit(4)})
    plain = edges.select("doc_id", "text", "lang", "source")
    against_sql(divergence.divergence(clashing).collect(), queries.ORACLE["op11_source_divergence"], documents=plain)


def test_divergence_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.QUERIES["op11_source_divergence"](spark, sf_dir).collect()
    against_sql(rows, queries.ORACLE["op11_source_divergence"], documents=docs)


def test_many_sources_and_a_hot_one(spark):
    # 150 sources make three tiles; a third of the rows belong to one of them.
    r = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [(i, " ".join(r.choices(words, k=12)), "en", "hot" if i % 3 == 0 else f"s{i % 149}") for i in range(900)]
    docs = sources_of(spark, rows)
    against_sql(divergence.divergence(docs).collect(), queries.ORACLE["op11_source_divergence"], documents=docs)


def test_counters_are_emitted_early_and_values_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 4)
    texts = [b"a b c d e f", b"a a q", b"x y z", b"g h i j k l m n o"]
    batch = pa.RecordBatch.from_pydict(
        {"lang": ["en"] * 4, "raw": pa.array(texts, pa.binary()),
         "sources": [[{"source": "s", "n": 2}], [{"source": "s", "n": 1}, {"source": "t", "n": 3}], [], [{"source": "t", "n": 1}]]}
    )
    out = list(divergence._count(iter([batch])))
    assert len(out) > 2
    total = Counter()
    for part in out:
        for x in part.to_pylist():
            total[x["source"], x["term"]] += x["n"] * 1000 + x["df"]
    assert total["s", "a"] == 4003 and total["t", "a"] == 6003 and total["t", "g"] == 1001 and ("t", "x") not in total
    big = spark.createDataFrame([(9 * 10**17, 9 * 10**18 - 5, 7)], "c long, n long, v long")
    assert big.select(divergence.smoothed("c", "n", "v")).first()[0] == 1 + 10**9 * (9 * 10**17 + 1) // (9 * 10**18 + 2)


# ---- sentence pieces --------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_op13_equals_the_library(spark, sf_dir, model):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_sentence_pieces"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = model.encode(texts[r.doc_id], add_eos=True)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r.n_tokens == len(ids) and r.ids_sha256 == digest(" ".join(map(str, ids)))
        assert r.decoded_sha256 == digest(model.decode(ids))


def test_pieces_of_edge_rows(edges, model):
    rows = sentence_pieces.encode(edges, PATH, decoded=True).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    expected = [(i, model.encode(t or "", add_eos=True)) for i, t, _ in EDGES]
    assert sorted(map(tuple, rows), key=key) == sorted([(i, ids, model.decode(ids)) for i, ids in expected], key=key)
    assert sentence_pieces.encode(edges.limit(0), PATH).count() == 0
    back = sentence_pieces.decode(sentence_pieces.encode(edges, PATH), PATH)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r[0]), r[2]) for r in rows)


def test_random_texts_equal_the_library(model):
    r, encode = random.Random(11), sentence_pieces.Encoder(PATH)
    odd = ["▁", " ", "   ", "\n", "\t", "0", "é", "日本", "①", "\x00", "<0x0A>", "</s>", "🙂", "́", "==", "the", "ing"]
    for _ in range(4000):
        kind = r.random()
        if kind < 0.4:
            text = "".join(r.choice(odd + list("abehint")) for _ in range(r.randint(0, 40)))
        elif kind < 0.8:
            text = "".join(r.choice(encode.pieces.forms) for _ in range(r.randint(1, 8)))
        else:
            text = "".join(r.choice("aetins ▁") for _ in range(r.randint(1, 80)))
        assert np.frombuffer(encode(text), "<u4").tolist() == model.encode(text, add_eos=True), text


def test_long_units_and_small_tables(model, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "PART_CHARS", 50)
    monkeypatch.setattr(sentence_pieces, "KEPT_UNITS", 20)
    monkeypatch.setattr(sentence_pieces, "KEPT_PAIRS", 20)
    encode = sentence_pieces.Encoder(PATH)
    for text in ("ab" * 20_000, " " * 20_000 + "x", "日本" * 10_000, "①x" * 10_000, LONG[:50_000], "a  b   c" * 999):
        assert np.frombuffer(encode(text), "<u4").tolist() == model.encode(text, add_eos=True)
