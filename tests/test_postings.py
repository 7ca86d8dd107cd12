"""Full-text scores: what is sent, and the same results by a broadcast and by a shuffle."""

from casewright import catalog
from casewright.operators import retrieve

DOCS = [(1, "a b b c"), (2, "b"), (2, "b"), (3, None), (4, ""), (5, "c c d, A")]


def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([(7, "a b"), (8, "C zz"), (9, "")], "query_id long, text string")


def test_pairs_of_query_and_document_are_not_shuffled(spark):
    plan = retrieve.bm25(*frames(spark), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(query_id" in plan and not [x for x in plan.split("\n") if "Exchange hashpartitioning(query_id" in x and "doc_id" in x.split("ENSURE")[0]]


def test_same_by_broadcast_and_shuffle(spark):
    docs, asked = frames(spark)
    few, many = (sorted(tuple(r) for r in retrieve.bm25(docs, asked, 3, most_sent=most).collect()) for most in (10**6, 0))
    assert few == many and [(r[0], r[1]) for r in few] == [(7, 1), (7, 2), (7, 5), (8, 1), (8, 5)]


def test_recall_looks_its_texts_up_once(spark, sf, monkeypatch):
    calls = []
    monkeypatch.setattr(retrieve, "contained", lambda *a, f=retrieve.contained: calls.append(1) or f(*a))
    assert catalog.eval_recall(spark, sf).count() > 0 and len(calls) == 1


def test_texts_of_claims_stay(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalog.claim_support_overlap(spark, sf)
        assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_that_may_hold_an_item_stay(spark):
    docs = spark.createDataFrame([(1, "x one two three four y"), (2, "one two"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four y"), (8, "two three one two")], "query_id long, text string")
    found = retrieve.contained(items, docs)
    assert [tuple(r) for r in found.collect()] == [(7, 1)] and "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()
