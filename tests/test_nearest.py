"""The exact search for neighbours: bounded batches, same answers as brute force."""

import numpy as np
import pandas as pd

from touchline.operators import neighbours
from touchline.operators.neighbours import nearest


def test_a_batch_of_questions_sends_bounded_frames():
    # Nothing is ruled out by the bound, so each of 3,000 rows asks in each of 40 tiles.
    x = np.random.default_rng(2).normal(size=(3000, 4))
    placed = pd.DataFrame({"cell": np.arange(40) % 5, "block": np.arange(40) // 5, "tile": np.arange(40), "home": np.arange(40)})
    batch = pd.DataFrame({"id": np.arange(3000), "features": list(x), "bound": np.nan, "home": np.arange(3000) % 40})
    sizes = [len(f) for f in neighbours._routed(batch, x[:5], placed, np.ones(40))]
    assert sum(sizes) == 3000 * 39 and max(sizes) <= neighbours.ROUTED


def test_rounded_squares_lose_no_neighbour(spark, limits):
    # Far from the origin expanded squares keep few digits; copies and ties must still come in order.
    r = np.random.default_rng(3)
    x = np.concatenate([1e6 + r.integers(0, 4, size=(300, 3)), r.normal(size=(300, 3)), np.ones((60, 3))]).astype(float)
    limits(PAIR_ROWS=20)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")
    found = sorted((v.id, v.rank, v.neighbour, v.distance) for v in nearest(df.repartition(4), 5).collect())
    expected = []
    for i, row in enumerate(x):
        d = np.sqrt(((x - row) ** 2).sum(axis=1))
        best = sorted((d[j], j) for j in range(len(x)) if j != i)[:5]
        expected += [(i, rank, j, e) for rank, (e, j) in enumerate(best, 1)]
    assert found == expected
