"""Overlap joins, order statistics and hash trees against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from casewright.functions import text
from casewright.operators import claims, quantiles, tools


def test_overlap_join_loses_no_pair(spark):
    rnd = random.Random(1)
    vocabulary = [f"word{k}" for k in range(40)] + ["the", "of"]
    some = lambda n: [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 12))) for _ in range(n)]
    left, right = [*some(40), None, "", "the"], [*some(60), None, ""]
    words = lambda t: {w for w in (t or "").split() if len(w) > 2 and w not in text.STOPWORDS}
    for least in (0.2, 0.45, 1.0):
        got = claims.overlapping(spark.createDataFrame([(t,) for t in left], "claim string"), spark.createDataFrame([(t,) for t in right], "t string"), least)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        want = {(a, b) for a in left if words(a) for b in right if b and len(words(a) & words(b)) / len(words(a)) >= least}
        assert {tuple(r) for r in got.collect()} == want
    with pytest.raises(ValueError):
        claims.overlapping(got.select("left"), got.select("right"), 0.0)


def test_repeated_claims_and_denials_keep_their_rows(spark):
    asked = spark.createDataFrame([(1, "He denied knowing Ann"), (2, "He denied knowing Ann"), (3, "He was there")], "id int, claim string")
    neg = spark.createDataFrame([("d", "denied knowing Ann"), ("e", "denied knowing Ann"), ("f", "else")], "doc_id string, text string")
    assert sorted((r.id, r.doc_id) for r in claims.denied(asked, neg, carry=("doc_id",)).collect()) == [(1, "d"), (1, "e"), (2, "d"), (2, "e")]


def test_order_statistics(spark):
    rnd = random.Random(5)
    groups = {
        "one": [3.5], "same": [7.0] * 400, "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300) for _ in range(300)] + [1e308, -1e308, 0.0],
        "dense": [1 + k * 2.0**-52 for k in range(50)], "skew": [0.0] * 500 + [rnd.random() for _ in range(100)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)], "g string, v double")
    wanted = spark.createDataFrame([(g, r) for g in [*groups, "none", "other"] for r in (0, 1, 57, 250, 299, 400, 10**6)], "g string, rank long")
    got = {(r.g, r["rank"]): r.v for r in quantiles.at_ranks(df, ["g"], "v", wanted, parts=16).collect()}
    assert got == {(g, r): sorted(vs)[r] for g, vs in groups.items() for r in (0, 1, 57, 250, 299, 400) if r < len(vs)}
    shares = quantiles.percentiles(df.where("g in ('one', 'skew')"), ["g"], "v", {"a": 0.5, "b": 0.99, "c": 0.95}, nearest=("c",)).collect()
    skew = sorted(groups["skew"])
    at = lambda s: skew[int(599 * s)] + (skew[min(599, int(599 * s) + 1)] - skew[int(599 * s)]) * (599 * s - int(599 * s))
    assert {r.g: (r.a, round(r.b, 9), r.c) for r in shares} == {"one": (3.5, 3.5, 3.5), "skew": (at(0.5), round(at(0.99), 9), skew[int(599 * 0.95 + 0.5)])}


def test_hash_tree(spark):
    rows = [(k, f"t{k % 50}") for k in range(900)]
    df = spark.createDataFrame(rows, "k int, t string")
    tree = tools.hash_tree(df, ["k", "t"], leaf=8).collect()
    depth = max(r.level for r in tree)
    assert depth == 2 and max(r.n for r in tree if r.level == depth) < 20
    other = tools.hash_tree(df.withColumn("t", F.when(F.col("k") == 3, "new").otherwise(F.col("t"))), ["k", "t"], leaf=8).collect()
    changed = {(r.level, r.prefix, r.hash) for r in tree} ^ {(r.level, r.prefix, r.hash) for r in other}
    # the branches of the old and the new row
    assert {x[0] for x in changed} == {0, 1, 2} and len(changed) <= 10
    root = lambda d: tools.corpus_hash(d, ["k", "t"]).collect()
    assert root(df)[0].corpus_hash == root(df.repartition(7).orderBy(F.rand()))[0].corpus_hash and root(df)[0].n_rows == 900
    assert root(df.unionByName(df.limit(1)))[0].corpus_hash != root(df)[0].corpus_hash and root(df.where("false")) == []
    many = df.limit(1).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).select("k", "t")
    assert [r.n for r in tools.hash_tree(many, ["k", "t"], leaf=8).collect()] == [20_000]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_balls_lose_no_neighbour(spark, metric):
    from casewright.operators import retrieve

    rnd = random.Random(3)
    centre = [[rnd.gauss(0, 4) for _ in range(5)] for _ in range(6)]
    rows = [(i, [x + rnd.gauss(0, 0.2) for x in centre[i % 6]]) for i in range(400)] + [(900, [1.0, 2.0]), (901, None), (902, [3.0, 1.0]), *((k, [1.0, 1.0, 1.0, 1.0, 1.0]) for k in range(500, 560))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for part in (20_000, 25):
        got = [(r.query_id, r.vec_id, r["rank"]) for r in retrieve.vector_top(vectors, queries, 7, metric, centres=12, part=part).collect()]
        held = {r.vec_id: list(r.embedding) for r in vectors.where("embedding is not null").collect()}
        dot = lambda a, b: sum(x * y for x, y in zip(a, b))
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) if metric == "l2" else 1 - dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5
        want = []
        for q in (v for v in held if v % 20 == 0):
            near = sorted((round(far(held[v], held[q]), 6) + 0.0, v) for v in held if len(held[v]) == len(held[q]))[:7]
            want += [(q, v, n) for n, (_, v) in enumerate(near, 1)]
        assert sorted(got) == sorted(want)
    # with clusters apart most balls are never met
    _, each, chosen = retrieve.balls(vectors, metric, 12)
    asks = retrieve._bounds(queries, each.withColumn("parts", F.lit(1)), chosen, metric)
    first = retrieve.vector_top(vectors, queries, 7, metric, centres=12).select("query_id", "distance")
    assert retrieve.remaining(asks, first, 7, metric).count() < 0.5 * asks.count()
