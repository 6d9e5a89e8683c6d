"""Forest of random projections against the exact search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators.imbalance import smote
from touchline.operators.neighbours import nearest
from touchline.operators.probing import nearest_probed, recall
from touchline.sources.derived import labelled_vectors

SCHEMA = "id long, features array<double>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA)


def test_recall_on_many_dimensions(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(150, 48)) * 2
    x = centres[r.integers(0, 150, 8000)] + r.normal(size=(8000, 48)) * 0.5
    df = frame(spark, x).repartition(8)
    found = nearest_probed(df, 5).cache()
    sample = df.filter("id % 40 = 0").select("id").collect()
    ids = [s["id"] for s in sample]
    d = ((x[ids][:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    d[np.arange(len(ids)), ids] = np.inf
    exact = spark.createDataFrame([(i, int(n)) for i, row in zip(ids, np.argsort(d, axis=1)[:, :5]) for n in row], "id long, neighbour long")
    assert recall(found, exact) >= 0.9
    # What is found is measured exactly, in order, and complete in number.
    rows = found.filter("id < 200").collect()
    assert len(rows) == 1000 and all(v.neighbour != v.id for v in rows)
    assert all(v.distance == pytest.approx(math.dist(x[v.id], x[v.neighbour])) for v in rows)
    by_id = {}
    for v in sorted(rows, key=lambda v: (v.id, v.rank)):
        by_id.setdefault(v.id, []).append((v.distance, v.neighbour))
    assert all(v == sorted(v) for v in by_id.values())
    found.unpersist()


def test_small_tables_are_exact(spark, sf_dir):
    df = labelled_vectors(spark, sf_dir).filter("id < 200")
    key = lambda d: sorted((r.id, r.rank, r.neighbour, round(r.distance, 9)) for r in d.collect())
    assert df.count() <= 256 and key(nearest_probed(df, 4)) == key(nearest(df.select("id", "features"), 4))


def test_copies_and_odd_rows(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 6))
    x[::3] = x[0]  # a third are copies
    df = frame(spark, x)
    odd = spark.createDataFrame([(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [math.nan] * 6), (None, [0.0] * 6), (5, [float(v) for v in x[5]])], SCHEMA)
    wide = df.unionByName(odd).withColumns({"vec": F.lit(1), "tree": F.lit("t"), "bucket": F.lit(2), "_n": F.lit(0)})
    found = {}
    for v in nearest_probed(wide, 4, leaf=40, spill=1.0).collect():
        found.setdefault(v.id, []).append((v.rank, v.neighbour))
    assert found.keys() == set(range(300))
    for i in range(300):
        brute = sorted((math.dist(x[i], x[j]), j) for j in range(300) if j != i)[:4]
        own = [n for _, n in sorted(found[i])]
        assert len(own) == 4
        if i % 3 == 0:
            assert own == [j for _, j in brute]
    hits = sum(n in [j for _, j in sorted((math.dist(x[i], x[j]), j) for j in range(300) if j != i)[:4]] for i in range(300) for _, n in found[i])
    assert hits >= 0.95 * 1200


def test_few_rows(spark):
    df = frame(spark, [[0.0, 1.0], [0.0, 1.0], [3.0, 1.0]])
    rows = sorted((v.id, v.rank, v.neighbour, v.distance) for v in nearest_probed(df, 5).collect())
    assert rows == [(0, 1, 1, 0.0), (0, 2, 2, 3.0), (1, 1, 0, 0.0), (1, 2, 2, 3.0), (2, 1, 0, 3.0), (2, 2, 1, 3.0)]
    assert nearest_probed(df.limit(0), 5).isEmpty() and nearest_probed(df.limit(1), 5).isEmpty()
    same = frame(spark, [[1.0, 1.0]] * 700)
    assert nearest_probed(same, 3).filter("distance = 0").count() == 2100


def test_smote_by_either_search(spark, sf_dir):
    df = labelled_vectors(spark, sf_dir)
    key = lambda d: sorted((r.id, r.copy, r.neighbour) for r in d.collect())
    assert key(smote(df, search=nearest_probed)) == key(smote(df))
