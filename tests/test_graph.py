import random

import pytest
from pyspark.sql import functions as F

from casewright import catalog
from casewright.operators import analytics, brokers, edges, walk
from casewright.projection import Graph

ENTITIES = [("p1", "Ann", "PERSON", 3), ("p2", "Bob", "PERSON", 2), ("p3", "Cy", "PERSON", 1), ("v1", "RX71 KLD", "VEHICLE", 1), ("l1", "Depot", "LOCATION", 5)]
RELS = [("r1", "p1", "v1", "OWNS", 0.92), ("r2", "p1", "l1", "OBSERVED_AT", 0.88), ("r3", "v1", "l1", "OBSERVED_AT", 0.90), ("r4", "p2", "l1", "OBSERVED_AT", 0.80), ("r5", "p2", "p3", "ASSOCIATED_WITH", 0.75), ("r6", "p1", "p3", "MENTIONED_WITH", 0.30)]


@pytest.fixture(scope="module")
def graph(spark):
    return Graph(
        spark.createDataFrame(ENTITIES, "entity_id string, canonical_name string, entity_type string, mention_count int"),
        spark.createDataFrame(RELS, "rel_id string, source_entity string, target_entity string, relation_type string, confidence double"),
        spark.createDataFrame([(f"e{r[0]}", r[0], "d1", 1, "said") for r in RELS] + [("e9", "r1", "d2", None, "again")], "evidence_id string, rel_id string, doc_id string, page int, span_text string"),
        spark.createDataFrame([("d1", "A"), ("d2", "B")], "doc_id string, case_ref string"),
    )


def test_edge_view(graph):
    got = {r.rel_id: r for r in edges.edge_view(graph).collect()}
    assert got["r1"].evidence_count == 2 and got["r1"].distinct_doc_count == 2 and got["r1"].weight < got["r2"].weight < got["r6"].weight
    assert {r.rel_id for r in edges.edge_view(graph, edges.EdgeFilter(case_ref="b")).collect()} == {"r1"}
    assert {r.rel_id for r in edges.edge_view(graph, edges.EdgeFilter(min_confidence=0.85, exclude_types=("owns",))).collect()} == {"r2", "r3"}
    assert [r.evidence_id for r in edges.top_citations(graph, 1).where("rel_id = 'r1'").collect()] == ["er1"]


def test_paths(graph):
    view = edges.best_edge_per_pair(edges.edge_view(graph)).select("source_entity", "target_entity", "weight")
    all_paths = [r.path for r in walk.simple_paths(view, "p1", "p3", 4, 10).collect()]
    assert set(all_paths) == {"p1>p3", "p1>l1>p2>p3", "p1>v1>l1>p2>p3"}
    strong = edges.best_edge_per_pair(edges.edge_view(graph, edges.EdgeFilter(min_confidence=0.5))).select("source_entity", "target_entity", "weight")
    got = walk.simple_paths(strong, "p1", "p3", 3, 5).collect()
    assert [r.path for r in got] == ["p1>l1>p2>p3"] and got[0].hops == 3
    none = edges.best_edge_per_pair(edges.edge_view(graph, edges.EdgeFilter(min_confidence=0.99))).select("source_entity", "target_entity", "weight")
    assert walk.simple_paths(none, "p1", "p3", 3, 5).count() == 0


def test_walks(spark, graph):
    rels = graph.relationships
    assert {(r.node, r.depth) for r in walk.k_hop(rels, spark.createDataFrame([("v1",)], "node string"), 2).collect()} == {("v1", 0), ("p1", 1), ("l1", 1), ("p2", 2), ("p3", 2)}
    assert {r.rel_id for r in walk.one_hop(rels, ["p2"]).collect()} == {"r4", "r5"}
    assert {r.rel_id for r in walk.induced(rels, spark.createDataFrame([("p1",), ("v1",), ("l1",)], "node string")).collect()} == {"r1", "r2", "r3"}
    two = {r.rel_id: r.hop for r in walk.two_stage(rels, ["p3"], 10).collect()}
    assert two["r5"] == 2 and two["r6"] == 2 and two["r4"] == 2 and "r3" not in two
    aliases = spark.createDataFrame([("p2", "Bobby")], "entity_id string, alias_text string")
    assert [walk.resolve_entity(graph.entities, aliases, n).collect()[0].entity_id for n in ("v1", "ann", "BOBBY")] == ["v1", "p1", "p2"]
    assert walk.resolve_entity(graph.entities, aliases, "nobody").count() == 0


def test_measures(spark, graph):
    view = edges.best_edge_per_pair(edges.edge_view(graph)).select("source_entity", "target_entity", "weight")
    top = analytics.degree_centrality(view).orderBy(F.desc("degree"), "node").first()
    assert (top.node, top.degree, top.centrality) == ("l1", 3, 0.75)
    rank = {r.node: r.rank for r in analytics.pagerank(view, 60).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9
    aff = {r.node: r.rank for r in analytics.pagerank(view, 60, mode="affinity").collect()}
    assert aff["l1"] == max(aff.values())


def test_betweenness_and_components_by_hand(spark):
    star = spark.createDataFrame([("a", "h", 1.0), ("b", "h", 1.0), ("c", "h", 1.0), ("x", "y", 1.0)], "source_entity string, target_entity string, weight double")
    got = {r.node: r.betweenness for r in brokers.betweenness(star).collect()}
    assert got["h"] == round(6 / 20, 6) and got["a"] == 0 and got["x"] == 0
    path = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0)], "source_entity string, target_entity string, weight double")
    assert {r.node: r.betweenness for r in brokers.betweenness(path).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z1", "z2")], "source_entity string, target_entity string")
    assert {r.component for r in analytics.components(chain).collect()} == {"n000", "z1"}


def test_modularity_by_hand(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 1.0)], "source_entity string, target_entity string, weight double")
    two = spark.createDataFrame([(n, 1 if n in "abc" else 2) for n in "abcdef"], "node string, community int")
    assert analytics.modularity(e, two).first().modularity == round(2 * (3 / 7 - (7 / 14) ** 2), 4)
    found = {r.node: r.community for r in analytics.label_propagation(e, 8).collect()}
    assert len({found[n] for n in "abc"}) == 1 and len({found[n] for n in "def"}) == 1


def test_components_of_long_paths(spark):
    def rows(order):
        return [(f"n{a:04d}", f"n{b:04d}") for a, b in zip(order, order[1:])]

    far, mixed = [0, *range(150, 0, -1)], list(range(1000, 1600))
    random.Random(3).shuffle(mixed)
    e = spark.createDataFrame([*rows(far), *rows(mixed), ("x1", "x1"), ("z2", "z1"), ("z1", "z2")], "source_entity string, target_entity string")
    want = {f"n{i:04d}": "n0000" for i in far} | {f"n{i:04d}": "n1000" for i in mixed} | {"x1": "x1", "z1": "z1", "z2": "z1"}
    got = analytics.components(e).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    with pytest.raises(RuntimeError, match="2 rounds"):
        analytics.components(e, most_rounds=2)
    assert analytics.components(e.where("false")).count() == 0


def test_rank_and_communities_of_the_whole_graph(spark, sf):
    links = [(r.source_entity, r.target_entity, r.weight) for r in catalog._best_edges(spark, sf).collect()]
    assert len({frozenset(x[:2]) for x in links}) == len(links) == catalog.best_edge_per_pair(spark, sf).count()
    near: dict[str, dict[str, float]] = {}
    for a, b, w in links:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    n, total = len(near), {a: sum(to.values()) for a, to in near.items()}
    rank = dict.fromkeys(near, 1 / n)
    for _ in range(8):
        rank = {a: 0.15 / n + 0.85 * sum(rank[b] * w / total[b] for b, w in to.items()) for a, to in near.items()}
    got = {r.node: r["rank"] for r in catalog.pagerank_all(spark, sf).collect()}
    assert got.keys() == rank.keys() and all(abs(got[a] - rank[a]) < 2e-9 for a in rank)

    parity = {r.node: r.p for r in spark.createDataFrame([(a,) for a in near], "node string").select("node", F.expr("pmod(xxhash64(node), 2)").alias("p")).collect()}
    label = {a: a for a in near}
    for k in range(6):
        won = {}
        for a, to in near.items():
            votes: dict[str, float] = {}
            for b, w in to.items():
                votes[label[b]] = votes.get(label[b], 0.0) + w
            won[a] = min((-round(w, 9), c) for c, w in votes.items())[1]
        label = {a: won[a] if parity[a] == k % 2 else label[a] for a in near}
    assert {r.node: r.community for r in catalog.communities_all(spark, sf).collect()} == label
