"""Top-k search against all inner products in Python's whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import pivotsearch

NAMES = ["query_id", "rank", "vec_id", "score"]


def brute(rows, k=20, scale=64):
    held = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(held):
        if q % 20:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b)), c) for j, (c, b) in enumerate(held) if j != at)[:k]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(found, 1)]
    return sorted(out)


def search(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score int, code string")
    got = pivotsearch.top_k(df, F.pmod("vec_id", F.lit(20)) == 0, **more)
    assert got.columns == NAMES
    return sorted(tuple(r) for r in got.collect())


SMALL = {"pivots": 5, "block": 7, "batch": 3, "first": 1, "sample": 40}


@pytest.mark.parametrize("kind", ["ties", "norms", "clusters"])
def test_equals_brute_force(spark, kind):
    rnd = random.Random(kind)
    draw = {
        "ties": lambda i: [rnd.choice([-1, 0, 0, 1]) / 64 for _ in range(4)],
        "norms": lambda i: [rnd.gauss(0, 10 ** rnd.randint(-2, 3)) for _ in range(6)],
        "clusters": lambda i: [rnd.gauss(5 * (j == i % 3), 0.1) for j in range(5)],
    }[kind]
    rows = [(i, draw(i)) for i in range(-60, 340)]
    assert search(spark, rows, **SMALL) == brute(rows)


def test_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(90)]
    rows += [(100, None), (120, [None, 1.0, 2.0]), (140, [math.nan, 0.0, 0.0]), (160, [math.inf, 0.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    rows += [(180, []), (200, [0.0, 0.0, 0.0]), (220, [1.5]), (221, [1.5, 0.0]), (240, [3.0, -2.0, 1.0, 4.0])]
    # repeated rows, an id with two vectors, and one vector of very many rows
    rows += [(40, rows[40][1]), (40, rows[40][1]), (60, [9.0, 9.0, 9.0]), *((i, [2.0, 2.0, 2.0]) for i in range(300, 420))]
    assert search(spark, rows, **SMALL) == brute(rows)


def test_few_rows_and_none(spark):
    assert search(spark, [(0, [1.0]), (20, [2.0]), (3, [1.0])]) == brute([(0, [1.0]), (20, [2.0]), (3, [1.0])])
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert search(spark, []) == []
    assert search(spark, [(0, None)]) == []


def test_large_components(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.choice([-1.0, 1.0]) * rnd.randint(10**6, 10**7) for _ in range(3)]) for i in range(60)]
    assert search(spark, rows, **SMALL) == brute(rows)
    with pytest.raises(Exception, match="too large|62 bits"):
        search(spark, [*rows, (99, [1e300, 0.0, 0.0])])


def test_bounds_skip_blocks_of_far_clusters(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(12, 8)) * 6
    x = np.floor(64 * (centres[np.arange(2400) % 12] + rnd.normal(size=(2400, 8)) * 0.05))
    codes = [pivotsearch.encode(v) for v in x]
    space = pivotsearch.Space(8, int((x**2).sum(1).max()), float(np.abs(x).max()), codes[:600], 24)
    far = space.far(space.lift(x), space.pivots)
    pivot, order = far.argmin(1), None
    order = np.lexsort((far.min(1), pivot))
    cuts = [order[i : i + 40] for i in range(0, 2400, 40)]
    cuts = [c[pivot[c] == p] for c in cuts for p in np.unique(pivot[c])]
    directory = {"cell": np.arange(len(cuts)), "block": np.arange(len(cuts)), "pivot": np.array([pivot[c[0]] for c in cuts]), "near": np.array([far[c, pivot[c]].min() for c in cuts]), "far": np.array([far[c, pivot[c]].max() for c in cuts])}
    q, scores = x[::20], x[::20] @ x.T
    best = np.sort(scores, axis=1)[:, -21].astype(int).tolist()
    batches = spark.createDataFrame([(0, [pivotsearch.encode(v) for v in q], best)], "batch long, codes array<binary>, best array<long>")
    asked = pivotsearch.plan_visits(batches, space, directory, 0, 10**6).collect()
    visits = {(int(pivotsearch.unpack(r.blob)[2][a]), int(p)) for r in asked for a, p in zip(*pivotsearch.unpack(r.blob)[:2], strict=True)}
    assert len(visits) < 0.4 * len(q) * len(cuts)
    # no block that holds one of the best is skipped
    for i in range(len(q)):
        for p, c in enumerate(cuts):
            assert (i, p) in visits or (scores[i, c] < best[i]).all()
