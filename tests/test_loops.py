"""Loops over edges: what a round sends."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import brokers, communities, edges
from casewright.session import bucketed

EDGES = [("b", "a", 1.0), ("c", "b", 2.0), ("C10", "C9", 1.0), (None, "a", 1.0), ("b", "é", 1.0)]


def test_numbers_follow_the_names(spark):
    ids, e = edges.numbered(spark.createDataFrame(EDGES, "source_entity string, target_entity string, weight double"))
    names = {r.id: r.name for r in ids.collect()}
    assert [names[k] for k in sorted(names)] == ["C10", "C9", "a", "b", "c", "é"]
    assert sorted((names[r.source_entity], names[r.target_entity], r.weight) for r in e.collect()) == sorted(x for x in EDGES if x[0])


def test_a_bucketed_table_is_not_shuffled_again(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = bucketed(spark.range(100).select((F.col("id") % 10).alias("node"), "id"), "node")
        state = spark.range(10).select(F.col("id").alias("node"))
        plan = state.join(held, "node")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and state.join(held, "node").count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_louvain_deals_its_edges_once_a_level(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(communities, "bucketed", lambda df, c: dealt.append(c) or bucketed(df, c))
    e = spark.createDataFrame([(f"{g}{i}", f"{g}{j}", 1.0) for g in "pq" for i in range(4) for j in range(i)] + [("p0", "q0", 0.1)], "source_entity string, target_entity string, weight double")
    groups = {}
    for r in communities.louvain(e).collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert groups == {"p0": {"p0", "p1", "p2", "p3"}, "q0": {"q0", "q1", "q2", "q3"}} and dealt and set(dealt) == {"neighbour"}


def test_distances_of_sixteen_pivots_share_a_row(spark):
    star = spark.createDataFrame([("hub", f"n{i:02}", 1.0) for i in range(19)], "source_entity string, target_entity string, weight double")
    got = {r.node: r.betweenness for r in brokers.betweenness(star).collect()}
    assert got == {"hub": 1.0} | {f"n{i:02}": 0.0 for i in range(19)}
    far = brokers._spread(bucketed(spark.createDataFrame([(0, 1, 5), (1, 0, 5), (2, 3, 1), (3, 2, 1)], "node long, neighbour long, w long"), "node"), spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 2)], "part int, slot int, node long"), 2)
    assert sorted(tuple(r) for r in far.collect()) == [(0, 0, 0, 5), (0, 1, 5, 0), (1, 2, 0, None), (1, 3, 1, None)]
