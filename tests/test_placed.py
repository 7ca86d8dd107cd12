"""Mentions that carry what is known of their document: the same results, without joins with the documents."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from casewright import catalog, projection
from casewright.operators import analytics, inventory, profile, tools, walk
from casewright.session import cut_lineage


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.createDataFrame([("d1", 1, "A", "a.txt"), ("d2", 2, "A", "b.txt"), ("d3", 3, "B", "c.txt")], "doc_id string, doc_key long, case_ref string, filename string")
    held = [("e1", "m1", "x", "d1", 2, "c1"), ("e1", "m1", "x", "d1", 2, "c1"), ("e1", "m2", None, "d2", None, "c2"), ("e1", "m3", "y", "d3", 1, "c3"), ("e2", "m4", "z", "d1", 1, "c1"), ("e2", None, "z", "d2", 1, "c1")]
    men = spark.createDataFrame([(*r, dt.datetime(2021, 1, 1 + k)) for k, r in enumerate(held)], "entity_id string, mention_id string, alias_text string, doc_id string, page int, chunk_id string, seen timestamp_ntz")
    ents = spark.createDataFrame([(e, e.upper(), "PERSON") for e in ("e1", "e2", "e3")], "entity_id string, canonical_name string, entity_type string")
    return ents, men, docs, men.join(docs, "doc_id")


def test_scope(spark, rows):
    ents, men, docs, placed = rows
    scope = tools.Scope("case", case_ref="A")
    plain, carried = tools.profile_in_scope(ents, men, docs, scope), tools.profile_in_scope(ents, placed, None, scope)
    assert sorted(plain.collect()) == sorted(carried.collect()) and {(r.entity_id, r.mention_count, r.doc_count) for r in carried.collect()} == {("e1", 2, 2), ("e2", 1, 2)}


def test_a_walk_ends_with_its_last_path(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(walk, "cut_lineage", lambda df: kept.append(1) or cut_lineage(df))
    e = spark.createDataFrame([(f"r{k}{end}", end, f"m{k}", 0.5) for k in range(3) for end in "st"], "rel_id string, source_entity string, target_entity string, confidence double")
    assert [r.path for r in walk.evidence_paths(e, "s", "t", 4, 3).collect()] == ["s>m0>t", "s>m1>t", "s>m2>t"] and len(kept) == 3


def test_documents(rows):
    _, men, docs, placed = rows
    plain, carried = profile.entity_documents(men, docs), profile.entity_documents(placed, None)
    assert sorted(plain.collect()) == sorted(carried.select(plain.columns).collect()) and carried.count() == 5


def test_entity_profile(rows):
    ents, men, docs, placed = rows
    plain, carried = tools.entity_profile(ents, men, docs.where("case_ref = 'A'")), tools.entity_profile(ents, tools.Scope("case", case_ref="A").rows(placed, None))
    assert sorted(plain.collect()) == sorted(carried.collect()) and carried.where("mention_count = 0").count() == 1


def test_sightings(rows):
    _, men, docs, placed = rows
    said = lambda df: df.withColumn("text", F.concat_ws(" ", "alias_text", F.lit("on 2021-05-02")))
    plain, carried = profile.sightings(said(men), docs), profile.sightings(said(placed), None)
    assert sorted(plain.collect()) == sorted(carried.collect()) and carried.count() == 6


def test_matches(rows):
    _, men, _, placed = rows
    n = men.groupBy("entity_id").agg(F.count("*").alias("mention_count"))
    plain = profile.grouped_matches(men.join(n, "entity_id").withColumn("score", F.col("page") / 10)).collect()
    assert plain == profile.grouped_matches(placed.withColumn("score", F.col("page") / 10), n).collect()
    assert [tuple(r) for r in plain] == [("e1", 0.2, 4, ["x", "y"], 3, 4), ("e2", 0.1, 2, ["z"], 2, 2)]


def test_the_second_stage_joins_nothing(spark):
    e = spark.createDataFrame([("r1", "a", "b", 0.9), ("r2", "b", "c", 0.8), ("r3", "c", "d", 0.7), ("r4", "b", None, 0.6)], "rel_id string, source_entity string, target_entity string, confidence double")
    got = walk.two_stage(e, ["a"], 5)
    assert {(r.rel_id, r.hop) for r in got.collect()} == {("r1", 2), ("r2", 2), ("r4", 2)} and "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_associations_rank_before_the_evidence(spark):
    ents = spark.createDataFrame([(e, e, "PERSON") for e in ("o", "a", "b", "c")], "entity_id string, canonical_name string, entity_type string")
    rels = spark.createDataFrame([(f"r{e}", "o", e, "KNOWS", 0.5) for e in "abc"], "rel_id string, source_entity string, target_entity string, relation_type string, confidence double")
    seen = spark.createDataFrame([("ra", "d1", 1, "e1"), ("rb", "d2", None, "e2"), ("rb", "d1", 1, "e3"), ("rc", "d1", 2, "e4")], "rel_id string, doc_id string, page int, evidence_id string")
    got = inventory.associations(rels, seen, ents, ents.where("entity_id = 'o'"), 2)
    assert [(r.neighbour, [tuple(c) for c in r.citations]) for r in got.collect()] == [("a", [("d1", 1)]), ("b", [("d2", None)])]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number") == 2


def test_search_deals_no_mentions_by_name(spark):
    ents = spark.createDataFrame([("e1", "Bob", "PERSON"), ("e2", None, "PERSON"), ("e3", "Eve", "PERSON")], "entity_id string, canonical_name string, entity_type string")
    men = spark.createDataFrame([("e1", "x", "d1"), ("e1", "bobby", "d1"), ("e2", "Bob", "d2"), ("e2", "y", "d2"), ("e3", None, "d1")], "entity_id string, alias_text string, doc_id string")
    got = tools.search_entities(men, ents, "BOB")
    assert [(r.entity_id, r.mention_count, r.aliases) for r in got.collect()] == [("e1", 2, ["bobby", "x"]), ("e2", 1, ["Bob"])]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "rightHint=(strategy=broadcast)" in plan


def test_links_deal_lines_by_node_alone(spark, sf):
    g = projection.trade_graph(spark, sf)
    held = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for k in held:
            spark.conf.set(k, "-1")
        plan = catalog.profile_links(spark, sf)._jdf.queryExecution().executedPlan().toString()
        # lines and orders by order, both ends of a line by node, what is taken and the names by neighbour
        assert plan.count("Exchange hashpartitioning") == 5 and "hashpartitioning(rel_id" not in plan
        for entity, most in ((None, 3), ("S1", 7), ("C1", 300), ("N3", 2)):
            plain, carried = profile.links(replace(g, ends=None), entity, most), profile.links(g, entity, most)
            assert sorted(plain.collect()) == sorted(carried.select(plain.columns).collect())
        assert 0 < sum(len(r.citations) for r in profile.links(g, "S1", 7).collect()) <= 7 and profile.links(g, "C999999999").count() == 0
    finally:
        for k in held:
            spark.conf.unset(k)


def test_links_of_a_source_are_one_for_each_target_before_rounds(spark, sf, monkeypatch):
    links, stars = [], analytics.stars
    monkeypatch.setattr(analytics, "stars", lambda e, rounds: links.append(e.count()) or stars(e, rounds))
    of = lambda rows: dict(analytics.components(spark.createDataFrame(rows, "source_entity string, target_entity string")).collect())
    buys = [(f"c{k}", f"s{j}") for k in range(30) for j in range(10)]
    got = of(buys + [("a", "b"), ("b", "d"), ("d", "a")])
    # nine targets and thirty sources with s0, and the ring
    assert links == [42] and len(got) == 43 and {got[n] for pair in buys for n in pair} == {"c0"} and {got[n] for n in "abd"} == {"a"}
    assert of([("x", "x"), ("y", None), (None, "z"), (None, "w"), ("p", "q"), ("p", "q"), ("q", "p")]) == {"x": "x", "y": "y", "z": "z", "w": "w", "p": "p", "q": "p"}
    g = projection.trade_graph(spark, sf)
    assert sorted(g.pairs().distinct().collect()) == sorted(g.relationships.select("source_entity", "target_entity").collect())
