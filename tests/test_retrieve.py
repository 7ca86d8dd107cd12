from pyspark.sql import functions as F

from casewright.operators import claims, media, retrieve, store, tools

CAND = "query_id string, source string, key string, doc_id string, score double, ordinal int"


def test_fusion(spark):
    rows = [("q", "fts", "chunk:1", "d1", 9.0, 1), ("q", "fts", "chunk:2", "d1", 5.0, 2), ("q", "vector", "chunk:2", "d1", 0.9, 1), ("q", "graph", "graph:r:d2", "d2", 0.8, 1), ("q", "graph", "graph:r:d2", "d2", 0.7, 2)]
    got = {r.key: r for r in retrieve.fuse(spark.createDataFrame(rows, CAND)).collect()}
    assert got["chunk:2"].rank_score == round(0.9 / 62 + 1.0 / 61, 9) and got["chunk:1"].rank_score == round(0.9 / 61, 9)
    assert got["graph:r:d2"].rank_score == round(1.3 / 61 + 1.3 / 62, 9) and got["graph:r:d2"].evidence_count == 2
    assert got["chunk:2"].supporting_sources == ["fts", "vector"] and got["chunk:2"].score == 5.0
    heavy = {r.key: r for r in retrieve.fuse(spark.createDataFrame(rows, CAND), {"fts": 5.0}).collect()}
    assert max(heavy, key=lambda k: heavy[k].rank_score) in ("chunk:1", "chunk:2")


def test_coverage(spark):
    rows = [("q", f"k{i}", d, s) for i, (d, s) in enumerate([("a", 0.9), ("a", 0.8), ("a", 0.7), ("b", 0.6), ("c", 0.5)])]
    got = retrieve.cover_documents(spark.createDataFrame(rows, "query_id string, key string, doc_id string, rank_score double"), 3, 2).collect()
    assert sorted(r.key for r in got) == ["k0", "k1", "k3"]
    got = retrieve.cover_documents(spark.createDataFrame(rows, "query_id string, key string, doc_id string, rank_score double"), 3, 5).collect()
    assert sorted(r.doc_id for r in got) == ["a", "b", "c"]
    assert retrieve.recall_mode("auto", False)[0] == "fast" and retrieve.recall_mode("auto", True) == ("balanced", 3, 4) and retrieve.recall_mode("exhaustive", False)[1] == 6


def test_keys(spark):
    none = F.lit(None).cast("string")
    df = spark.range(1)
    key = lambda *a: df.select(retrieve.result_key(*a)).first()[0]
    assert key(F.lit("graph"), F.lit("r"), none, F.lit("d"), none, F.lit(4)) == "graph:r:d"
    assert key(F.lit("exact"), none, F.lit("e"), none, none, F.lit(4)) == "exact:e:4"
    assert key(F.lit("fts"), none, none, F.lit("d"), F.lit("c"), F.lit(4)) == "chunk:c"
    assert key(F.lit("fts"), none, none, none, none, F.lit(4)) == "fts:item:4"
    assert retrieve.exact_tokens("RX71 KLD and +44 7712 345678 of OP_NIGHT") == ["RX71 KLD", "+44 7712 345678", "OP_NIGHT"]


def test_vectors_of_other_lengths_are_left_out(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0])], "vec_id int, embedding array<float>")
    q = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, query array<float>")
    got = retrieve.vector_top(v, q, 5).collect()
    assert [(r.vec_id, r.distance, r.similarity) for r in sorted(got, key=lambda r: r.rank)] == [(1, 0.0, 1.0), (2, 1.0, 0.5)]


def test_claims(spark):
    rows = [("the grey van left harbour", ["A grey van left the harbour."]), ("quiet harbour people sleeping", ["The harbour was quiet"]), ("nothing like that", ["zzz"]), ("no spans", []), ("null spans", None), ("a b c", ["a b c"])]
    got = {r.claim: (r.status, r.confidence) for r in claims.validate(spark.createDataFrame(rows, "claim string, spans array<string>")).collect()}
    assert got == {"the grey van left harbour": ("SUPPORTED", 0.75), "quiet harbour people sleeping": ("PARTIALLY_SUPPORTED", 0.55), "nothing like that": ("UNSUPPORTED", 0.2), "no spans": ("UNSUPPORTED", 0.1), "null spans": ("UNSUPPORTED", 0.1), "a b c": ("UNSUPPORTED", 0.2)}
    docs = spark.createDataFrame([("d", 1, "He denied it"), ("d", 1, "He denied it"), ("e", 2, "He knows"), ("f", 1, None)], "doc_id string, page int, text string")
    neg = claims.negative_evidence(docs)
    assert [(r.doc_id, r.kind) for r in neg.collect()] == [("d", "explicit_denial")]
    asked = spark.createDataFrame([("He denied knowing it",), ("He was there",)], "claim string")
    assert [r.claim for r in claims.denied(asked, neg).collect()] == ["He denied knowing it"]
    assert [r.claim for r in claims.denied(asked, neg.withColumn("text", F.lit("nothing alike"))).collect()] == []


def test_store(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    one = store.last_wins(new, ["k"], [F.desc("n")])
    assert sorted((r.k, r.v) for r in store.upsert(held, one, ["k"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert store.last_wins(spark.createDataFrame([(None, 1), (None, 2)], "k int, n int"), ["k"], [F.desc("n")]).count() == 2
    cases = store.create_cases(spark.createDataFrame([("1", "OP_A")], "case_id string, case_ref string"), spark.createDataFrame([("2", "op_a"), ("3", "OP_B"), ("4", "op_b")], "case_id string, case_ref string"))
    assert sorted(r.case_id for r in cases.collect()) == ["1", "3"]
    done, failed = store.review(held, spark.createDataFrame([(1,), (9,)], "k int"), "k")
    assert [r.k for r in done.collect()] == [1] and [r.k for r in failed.collect()] == [9]
    tables = {"entities": spark.createDataFrame([("a",), ("b",)], "entity_id string"), "entity_aliases": spark.createDataFrame([("a", 1), ("b", 2)], "entity_id string, alias_id int"), "relationships": spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "b")], "rel_id string, source_entity string, target_entity string"), "relationship_evidence": spark.createDataFrame([("r1",), ("r1",), ("r2",)], "rel_id string")}
    _, counts = store.delete_entities(tables, spark.createDataFrame([("a",)], "entity_id string"))
    assert {r.table: r.deleted for r in counts.collect()} == {"entities": 1, "entity_aliases": 1, "relationships": 1, "relationship_evidence": 2}
    ents = spark.createDataFrame([("a", 0.3, None, None), ("b", 0.4, None, None)], "entity_id string, confidence double, reviewed_at timestamp, reviewed_by string")
    import datetime as dt

    got = {r.entity_id: (r.confidence, r.reviewed_by) for r in store.confirmed(ents, spark.createDataFrame([("a", dt.datetime(2024, 1, 1), "me")], "entity_id string, reviewed_at timestamp, reviewed_by string")).collect()}
    assert got == {"a": (1.0, "me"), "b": (0.4, None)}


def test_changed_sources(spark):
    files = spark.createDataFrame([("x", "c", "h2"), ("y", "c", "h1"), ("z", "c", "h"), ("w", "c", "h")], "filepath string, case_id string, source_hash string")
    docs = spark.createDataFrame([("d1", "x", "c", "h1", 1), ("d2", "y", "c", "h0", 1), ("d3", "y", "c", "h1", 2), ("d4", "w", "c", None, 1)], "doc_id string, filepath string, case_id string, source_hash string, ingested_at int")
    assert sorted((r.filepath, r.supersedes_doc_id) for r in store.changed_sources(files, docs).collect()) == [("x", "d1"), ("z", None)]


def test_scope(spark):
    import pytest

    docs = spark.createDataFrame([("d1", "A"), ("d2", "B")], "doc_id string, case_ref string")
    rows = spark.createDataFrame([("d1", 1), ("d2", 2)], "doc_id string, n int")
    assert [r.n for r in tools.Scope("case", case_ref="A").rows(rows, docs).collect()] == [1]
    assert [r.n for r in tools.Scope("document", doc_ids=("d2",)).rows(rows, docs).collect()] == [2] and tools.Scope().rows(rows, docs).count() == 2
    for bad in (lambda: tools.Scope("document"), lambda: tools.Scope("case"), lambda: tools.Scope("x"), lambda: tools.Scope("case", case_ref="A").check(docs, "d2")):
        with pytest.raises(tools.ScopeViolation):
            bad()
    m = spark.createDataFrame([("e1", "Bobby", "d1"), ("e1", "Rob", "d1"), ("e2", "Al", "d2")], "entity_id string, alias_text string, doc_id string")
    e = spark.createDataFrame([("e1", "Robert", "PERSON"), ("e2", "Alan", "PERSON")], "entity_id string, canonical_name string, entity_type string")
    assert [(r.entity_id, r.mention_count) for r in tools.search_entities(m, e, "BOB").collect()] == [("e1", 1)]


def test_media(spark):
    times = spark.createDataFrame([(10.0,), (0.0,), (1.0,)], "d double").select(media.frame_times(F.col("d"))).collect()
    assert times[0][0][0] == 0.3 and times[0][0][-1] == 9.7 and len(times[0][0]) == 8 and times[1][0] == [0.0] and times[2][0][-1] == 1.0
    boxes = spark.createDataFrame([("f", "a", "car", 0.9, 1, 0.0, 0.0, 10.0, 10.0), ("f", "b", "car", 0.8, 1, 1.0, 0.0, 10.0, 10.0), ("f", "c", "dog", 0.7, 1, 2.0, 2.0, 4.0, 4.0), ("f", "d", "car", 0.6, 1, 300.0, 300.0, 310.0, 310.0)], "frame_id string, detection_id string, label string, confidence double, priority int, x1 double, y1 double, x2 double, y2 double")
    kept = media.merge_detections(boxes)
    assert sorted(r.detection_id for r in kept.collect()) == ["a", "c", "d"]
    rel = media.spatial_relations(kept.withColumn("width", F.lit(640.0)).withColumn("height", F.lit(480.0))).collect()
    assert [(r.a, r.b, r.relation_type, r.confidence) for r in rel] == [("a", "c", "CONTAINS", 0.7)]
    assert spark.range(1).select(media.position_text(F.lit(0.1), F.lit(0.9)), media.position_text(F.lit(0.5), F.lit(0.5)), media.scale_text(F.lit(0.1))).first() == ("in the lower left of the frame", "near the centre of the frame", "medium-sized")
