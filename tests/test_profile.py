"""Profiles, tracks and grouped matches on small rows with nulls, ties and empty tables."""

import datetime as dt

import pytest

from casewright.operators import profile
from casewright.projection import Graph


@pytest.fixture(scope="module")
def graph(spark):
    entities = spark.createDataFrame([("v", "AB12 CDE", "VEHICLE", None, None), ("p", "Yard", "Location", 1.0, 2.0), ("q", "Dock", "LOCATION", None, 2.0)], "entity_id string, canonical_name string, entity_type string, latitude double, longitude double")
    rels = spark.createDataFrame([("r1", "v", "p", "SEEN", 0.5), ("r2", "p", "v", "OBSERVED_AT", 0.9), ("r3", "v", "q", "OBSERVED_AT", 0.9), ("r4", "v", "gone", "OBSERVED_AT", 1.0)], "rel_id string, source_entity string, target_entity string, relation_type string, confidence double")
    evidence = spark.createDataFrame([("e1", "r1", "d1", 2, "anpr hit on 3 May 2021"), ("e2", "r1", "d1", 1, "parked"), ("e3", "r2", "d2", None, None), ("e4", "r2", "d1", 1, "on 2021-05-01"), ("e5", "r3", "d1", 1, "sighting"), ("e6", "r2", None, 1, "x")], "evidence_id string, rel_id string, doc_id string, page int, span_text string")
    documents = spark.createDataFrame([("d1", "a.txt", "c"), ("d2", "b.txt", None)], "doc_id string, filename string, case_ref string")
    return Graph(entities, rels, evidence, documents)


def test_track(graph):
    got = profile.vehicle_track(graph, "v").orderBy("position").collect()
    assert [(r["doc_id"], r["excerpt"], r["seen_at"]) for r in got] == [("d1", "on 2021-05-01", dt.datetime(2021, 5, 1)), ("d1", "anpr hit on 3 May 2021", dt.datetime(2021, 5, 3)), ("d2", "", None)]
    assert profile.vehicle_track(graph, "p").count() == 0


def test_links(graph):
    got = {r["rel_id"]: [(c["doc_id"], c["page"], c["span_text"]) for c in r["citations"]] for r in profile.links(graph, "v").collect()}
    # r4's other end is no entity; the row without document is no citation
    assert got == {"r1": [("d1", 1, "parked"), ("d1", 2, "anpr hit on 3 May 2021")], "r2": [("d1", 1, "on 2021-05-01"), ("d2", None, "")], "r3": [("d1", 1, "sighting")]}
    assert sum(len(r["citations"]) for r in profile.links(graph, "v", most=2).collect()) == 2


def test_network(graph):
    got = [(r["rel_id"], r["evidence_count"]) for r in profile.network(graph, 2).orderBy("rel_id").collect()]
    assert got == [("r2", 3), ("r3", 1)]
    assert tuple(profile.average_confidence(graph.relationships).first()) == (4, 0.825)
    assert tuple(profile.average_confidence(graph.relationships.where("1 = 0")).first()) == (0, 0.0)


def test_profile(spark, graph):
    mentions = spark.createDataFrame([("v", "m1", "d1", 3, "b", "seen on 2021-05-02"), ("v", "m1", "d1", 3, "b", "seen on 2021-05-02"), ("v", "m2", "d1", None, "a", None), ("v", "m3", None, 1, None, "2021-01-01"), (None, "m4", "d1", 1, "z", "x")], "entity_id string, mention_id string, doc_id string, page int, alias_text string, text string")
    attachments = spark.createDataFrame([("a1", "v", dt.datetime(2021, 1, 1)), ("a2", "v", None), ("a3", "v", dt.datetime(2021, 1, 2)), ("a4", "p", None)], "attachment_id string, entity_id string, uploaded_at timestamp_ntz")
    parts = profile.full_profile(graph, mentions, attachments, "v")
    assert [r["alias_text"] for r in parts["aliases"].collect()] == ["a", "b"]
    assert [(r["doc_id"], r["first_page"], r["mention_count"]) for r in parts["documents"].collect()] == [("d1", 3, 2)]
    assert {r["seen_at"] for r in parts["timeline"].collect()} == {dt.datetime(2021, 5, 2)}
    assert [r["attachment_id"] for r in parts["attachments"].collect()] == ["a3", "a1", "a2"]
    assert profile.without_attachment(attachments, "a1").count() == 3
    assert all(part.count() == 0 for part in profile.full_profile(graph, mentions, attachments, "nobody").values())


def test_matches(spark):
    rows = [("e", 5, "x", "d1", 0.5), ("e", 5, "y", "d1", None), ("e", None, "", None, 0.7), (None, 9, "z", "d1", 1.0), ("", 9, "z", "d1", 1.0), ("f", None, None, None, None)]
    got = profile.grouped_matches(spark.createDataFrame(rows, "entity_id string, mention_count int, alias_text string, doc_id string, score double")).collect()
    assert [tuple(r) for r in got] == [("e", 0.7, 5, ["x", "y"], 2, 3), ("f", 0.0, 0, [], 1, 1)]
