"""Resolving lists of names and profiles inside a scope; the order of fused rows."""

import pytest
from pyspark.sql import functions as F

from casewright.operators import retrieve, tools


@pytest.fixture(scope="module")
def model(spark):
    ents = spark.createDataFrame([("e1", "Ann Hart", "PERSON", 3), ("e2", "Anna Hartley", "PERSON", 9), ("e3", "Depot", "LOCATION", 1), ("e4", "Gone", "PERSON", 5)], "entity_id string, canonical_name string, entity_type string, mention_count int")
    rows = [("e1", "m1", "Annie", "d1", 4, "c1"), ("e1", "m2", "Ann Hart", "d1", None, None), ("e1", "m3", "A. Hart", "d2", 2, "c3"), ("e2", "m4", "Anna", "d2", 1, "c4"), ("e3", "m5", "the DEPOT", "d1", 1, "c1"), ("e4", "m6", "Gone", "d3", 1, "c9")]
    docs = spark.createDataFrame([("d1", "A", "one.pdf"), ("d2", "A", "two.pdf"), ("d3", "B", "three.pdf")], "doc_id string, case_ref string, filename string")
    return ents, spark.createDataFrame(rows, "entity_id string, mention_id string, alias_text string, doc_id string, page int, chunk_id string"), docs


def test_names_stand_for_all_their_hits(model):
    ents, men, docs = model
    inside = tools.Scope("case", case_ref="A").rows(men, docs)
    ids = lambda *names: [r.entity_id for r in tools.resolve_ids(ents, inside, list(names)).collect()]
    assert ids("ann hart") == ["e1"] and ids("ANNIE", "e1", "e3") == ["e1", "e3"]
    # no exact hit: all that have it, by mentions
    assert ids("hart") == ["e2", "e1"] and ids("depo", "hart") == ["e3", "e2", "e1"]
    assert ids("Gone") == ids("", " ") == ids("nobody") == []


def test_profiles(model):
    ents, men, docs = model
    got = {r.entity_id: r for r in tools.profile_in_scope(ents, men, docs, tools.Scope("case", case_ref="A")).collect()}
    assert set(got) == {"e1", "e2", "e3"}
    one = got["e1"]
    assert (one.mention_count, one.doc_count, one.top_aliases) == (3, 2, ["A. Hart", "Ann Hart", "Annie"])
    assert [(c.doc_id, c.doc_name, c.page, c.chunk_id) for c in one.citations] == [("d2", "two.pdf", 2, "c3"), ("d1", "one.pdf", 4, "c1"), ("d1", "one.pdf", 0, None)]
    assert (one.first_seen_doc, one.first_seen_page, one.last_seen_doc, one.last_seen_page) == ("two.pdf", 2, "one.pdf", 0)
    few = tools.profile_in_scope(ents, men, docs, tools.Scope(), most=1, most_aliases=2).where("entity_id = 'e1'").first()
    assert len(few.citations) == 1 and few.top_aliases == ["A. Hart", "Ann Hart"]


def test_equal_ranks_fall_by_priority_and_score(spark):
    rows = [("q", "a", "d1", 0.5, 1.0, 0.2), ("q", "b", "d2", 0.5, 3.0, 0.1), ("q", "c", "d3", 0.5, 3.0, 0.9), ("q", "d", "d4", 0.7, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "query_id string, key string, doc_id string, rank_score double, priority double, score double")
    assert [r.key for r in df.orderBy(*retrieve.ranked_order()).collect()] == ["d", "c", "b", "a"]
    assert [r.key for r in retrieve.cover_documents(df, 3, 1).collect()] == ["d", "c", "b"]
    assert retrieve.cover_documents(df, 3, 1).columns == ["query_id", "key", "doc_id", "rank_score"]
    assert [r.key for r in retrieve.cover_documents(df.drop("priority", "score"), 2, 1).orderBy(F.desc("rank_score"), "key").collect()] == ["d", "a"]
