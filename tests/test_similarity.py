"""Name similarity without loss, against all pairs, and resolution against the sequential rule."""

import random

import pytest
from pyspark.sql import functions as F

from casewright.functions.normalise import jaro_winkler, jaro_winkler_column
from casewright.operators import resolve


def names_of(rnd, n):
    base = ["".join(rnd.choice("abcdefgh  é") for _ in range(rnd.randint(1, 14))).strip() or "a" for _ in range(n // 3)]
    out = set(base)
    while len(out) < n:
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(1, 3)):
            k = rnd.randrange(len(w) + 1)
            w[k : k + rnd.randint(0, 1)] = rnd.choice(["", "x", "ab", "h"])
        out.add("".join(w) or "q")
    return sorted(out)


def test_column_equals_function(spark):
    rnd = random.Random(6)
    rows = [(a, b) for a, b in zip(names_of(rnd, 150), reversed(names_of(rnd, 150)))] + [("martha", "marhta"), ("dixon", "dicksonx"), ("a", "b"), ("aa", "aa"), ("😀ab", "ab😀")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", jaro_winkler_column(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(abs(r.s - jaro_winkler(r.a, r.b)) < 1e-12 for r in got)


@pytest.mark.parametrize("threshold", [0.88, 0.7])
def test_no_pair_is_lost(spark, threshold):
    names = names_of(random.Random(int(threshold * 100)), 160) + ["Sam Webb", "am SWebb", "Webb Sam"]
    df = spark.createDataFrame([(t, n) for n in names for t in ("P", "Q") if t == "P" or n[0] < "d"] + [("P", "")], "entity_type string, name string")
    want = {(t, a, b) for t, some in (("P", names), ("Q", [n for n in names if n[0] < "d"])) for a in some for b in some if a < b and jaro_winkler(a, b) >= threshold}
    met = resolve.candidate_pairs(df, threshold)
    assert {(r.entity_type, r.a, r.b) for r in resolve.similar_pairs(df, threshold).collect()} == want
    if threshold == 0.88:
        assert met.count() < 0.2 * len(names) ** 2 / 2
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_resolution_is_the_sequential_rule(spark):
    rnd = random.Random(9)
    names = names_of(rnd, 120)
    rnd.shuffle(names)
    rows = [("P", n, k // 2) for k, n in enumerate(names)]
    want, canonical = {}, []
    for _, n, k in sorted(rows, key=lambda r: (r[2], r[1])):
        hit = next(((c, s) for c in canonical if (s := jaro_winkler(n, c)) >= 0.88), None)
        if hit is None:
            canonical.append(n)
        want[n] = (hit[0], hit[1], "jaro_winkler") if hit else (n, 1.0, "new_entity")
    got = {r.name: (r.canonical_name, r.score, r.method) for r in resolve.resolve(spark.createDataFrame(rows, "entity_type string, name string, seen int")).collect()}
    assert got.keys() == want.keys()
    assert all(got[n][0] == want[n][0] and got[n][2] == want[n][2] and abs(got[n][1] - want[n][1]) < 1e-12 for n in want)
    assert resolve.resolve(spark.createDataFrame([], "entity_type string, name string, seen int")).count() == 0
