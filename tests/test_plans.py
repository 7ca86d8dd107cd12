import json
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from casewright import schemas
from casewright.plans import answers, evaluation, hybrid, ingest, intents, report
from casewright.projection import Graph, trade_graph
from casewright.sources import files, tabular, threads

PAGES = [
    ("d1", "A", "one.pdf", 1, "Anna Hart is associated with Ben Cole. Mail anna@x.example.com or call 07712 345 678."), ("d1", "A", "one.pdf", 2, "Plate RX71 KLD was parked. anna@x.example.com wrote [redacted]."),
    ("d2", "B", "two.pdf", 1, "The van RX71KLD met bob@y.example.com. He denied it."), ("d3", "A", "three.pdf", 1, None), ("d4", "B", "four.pdf", 1, ""),
]


@pytest.fixture(scope="module")
def ingested(spark):
    return ingest.ingest_pages(spark.createDataFrame(PAGES, "doc_id string, case_id string, filename string, page int, text string"))


def test_ingest(ingested, tmp_path, spark):
    names = {(r.canonical_name, r.entity_type): r for r in ingested.entities.collect()}
    assert {("RX71 KLD", "VEHICLE"), ("anna@x.example.com", "EMAIL"), ("+447712345678", "PHONE")} <= set(names)
    plate = names["RX71 KLD", "VEHICLE"]
    assert {r.source_doc for r in ingested.entity_aliases.where(F.col("entity_id") == plate.entity_id).collect()} == {"d1", "d2"} and plate.mention_count == 3
    assert ingested.relationships.count() == ingested.relationship_evidence.count() > 0
    assert {r.doc_id for r in ingested.page_quality.where("evidence_gap").collect()} == {"d1"}
    assert ingested.documents.count() == 4
    ingested.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "entities")).schema.fieldNames() == schemas.schema_of("entities").fieldNames()


@pytest.fixture(scope="module")
def evidence(spark, ingested):
    docs = ingested.documents.select("doc_id", F.col("case_id").alias("case_ref"), "filename")
    rels = ingested.relationships
    graph = Graph(ingested.entities, rels.select("rel_id", "source_entity", "target_entity", "relation_type", F.coalesce("confidence", F.lit(0.5)).alias("confidence")), ingested.relationship_evidence.select("evidence_id", "rel_id", "doc_id", "page", "span_text"), docs)
    mentions = ingested.entity_aliases.select("alias_id", "entity_id", "alias_text", F.col("source_doc").alias("doc_id"), F.col("source_chunk").alias("chunk_id"))
    vectors = ingested.chunks.select("chunk_id", "doc_id", F.array(F.lit(1.0), F.col("chunk_index").cast("double")).cast("array<float>").alias("vector"))
    return hybrid.Store(graph, ingested.chunks, mentions, vectors)


def test_run_query(spark, evidence):
    got = hybrid.run_query(spark, "Where was plate RX71 KLD parked?", evidence, strict=False, query_vector=[1.0, 0.0])
    assert got.intent == "exact_identifier_query" and "RX71" in got.answer or got.packet["exact_matches"].count() > 0
    sources = {s for r in got.ranked.collect() for s in r.supporting_sources}
    assert {"exact", "fts", "vector"} <= sources
    scoped = hybrid.run_query(spark, "Where was the van?", evidence, case_ref="A")
    assert {r.doc_id for r in scoped.ranked.collect()} <= {"d1", "d3"}
    one = hybrid.run_query(spark, "summary of two.pdf", evidence, doc_ids=("d2",), strict=False)
    assert one.intent == "document_summary_query" and "p. 1" in one.answer and one.packet["negative_evidence"].count() == 1
    model = hybrid.run_query(spark, "Where was the van?", evidence, answer=lambda q, p: "no citations here")
    assert model.answer == "no citations here" and model.claims == []


def test_cached_answers(spark, evidence):
    cache = hybrid.QueryCache(4)
    ask = lambda q, **more: hybrid.run_query(spark, q, evidence, cache=cache, strict=False, **more)
    first = ask("summary of two.pdf", doc_ids=("d2",), corpus="h1")
    again = ask(" Summary  of two.PDF", doc_ids=("d2",), corpus="h1")
    assert not first.cache_hit and again.cache_hit and again.answer == first.answer and again.claims == first.claims
    assert not ask("summary of two.pdf", doc_ids=("d2",), corpus="h2").cache_hit


def test_cache():
    c = hybrid.QueryCache(2)
    a, b, d = (c.key(q, "case", "hash") for q in ("Q ", "x", "y"))
    assert a == c.key("q", "CASE", "hash")
    for k in (a, b, a, d):
        c.get(k) or c.put(k, k)
    assert c.get(b) is None and c.get(a) == a


INTENTS = [
    ("list all vehicles", "entity_inventory_query"), ("phones", "entity_inventory_query"), ("How is Anna Hart connected to Ben Cole?", "entity_relationship_query"), ("Who used RX71 KLD?", "exact_identifier_query"),
    ("summary of report-1.pdf", "document_summary_query"), ("what does a.pdf say", "document_query"), ("list people associated with vehicles", "entity_relationship_inventory_query"), ("what happened at night", "general_query"), ("who lives at Mill Lane", "general_query"), ("Who is John Smith?", "entity_relationship_query"), ("List all weapons connected to John Smith", "entity_relationship_inventory_query"), ("Show AB12 CDE in report.pdf", "exact_identifier_query"),
    ("phone numbers", "entity_inventory_query"), ("List all phone numbers linked to this case and who they are associated with.", "entity_relationship_inventory_query"), ("22 Linton Gardens", "general_query"), ("Summarise key findings from OC-INT-003.pdf", "document_summary_query"),
]


@pytest.mark.parametrize("question, intent", INTENTS)
def test_intents(question, intent):
    assert intents.parse(question)["intent"] == intent


def test_planning():
    assert intents.with_history("and then he?", [("user", "Tell me of Ann"), ("assistant", "She left.\n\nSoon.")]) == "user: Tell me of Ann\nassistant: She left.\nassistant: Soon.\nand then he?"
    assert intents.with_history("A full question about the harbour that stands alone", [("user", "x")]).startswith("A full")
    p = intents.plan("How is Anna Hart connected to Ben Cole since 2024-01-02?")
    assert p["search_strategy"] == "graph_forward" and p["subjects"] == p["graph_expansion_targets"] == ["Anna Hart", "Ben Cole"] and p["filters"]["date_hints"] == ["2024-01-02"]
    assert p["suggested_pivots"][2] == "Build a chronology for Anna Hart with exact citations." and p["planner_status"] == "fallback"
    q = intents.plan("List all phone numbers linked to this case and who they are associated with.")
    assert q["intent"] == "entity_relationship_inventory_query" and q["filters"]["entity_types"] == ["PHONE"] and "phone" in q["suggested_pivots"][0]
    assert [intents.plan(x)["search_strategy"] for x in ("phones", "summary of a.pdf", "what happened at night")] == ["exact_then_fts", "document_focus", "hybrid_balanced"]
    assert intents.plan("x", refine=lambda m: {"intent": 5, "search_strategy": "own"})["intent"] == "general_query"
    r = intents.plan("x", refine=lambda m: {"intent": "document_query", "subjects": ["A", "a ", None], "filters": {"date_hints": "2024"}, "suggested_pivots": list("abcdefg"), "rewrite_query": " "})
    assert (r["intent"], r["subjects"], r["filters"]["date_hints"], r["suggested_pivots"], r["rewrite_query"], r["planner_status"]) == ("document_query", ["A"], ["2024"], list("abcde"), "x", "refined")
    assert intents.plan("x", refine=lambda m: 1 / 0)["search_strategy"] == "hybrid_balanced"
    assert intents.with_history("phones of them", [("user", "x")]) == "phones of them"
    assert [t["template_id"] for t in intents.TEMPLATES] == ["known_associates", "phones_by_case", "location_movements"]
    assert intents.parse("Give me a comprehensive report, don't miss related docs")["recall_priority"]


def test_findings_and_exact_groups():
    rows = [{"doc_id": "d", "page": p, "text": t} for p, t in [(2, "HANDLING: for all who are named in it and nobody else at all. The grey van was observed at 10:30 in Mill Lane by John Smith."), (1, "THE WHOLE LINE IS IN CAPITALS AND SAYS NOTHING TO ANYONE. a|b|c is a line of a table and not a finding at all."), (1, "A phone call was linked to the address; short one."), (3, "the grey van was observed at 10:30 in mill lane by john smith.")]]
    got = answers.findings(rows)
    assert [f["text"][:12] for f in got] == ["The grey van"]
    assert answers.weight_of("The grey van was observed at 10:30 in Mill Lane by John Smith.") == 2 * 2 + 2 + 2 + 1 + 1 + 2
    assert answers.is_boilerplate("Analyst: X") and not answers.is_boilerplate("a plain line")
    groups = answers.exact_groups([{"entity_id": "a", "score": 0.5, "doc_id": "x", "alias_text": "A1"}, {"entity_id": "b", "score": 1.0, "doc_id": "x", "canonical_name": "B"}, {"entity_id": "a", "score": 1.0, "doc_id": "y", "alias_text": "A0", "page": 3}, {"entity_id": None}])
    assert [(g["entity_id"], g["name"], g["aliases"], g["documents"]) for g in groups] == [("a", "A1", ["A0", "A1"], ["x", "y"]), ("b", "B", [], ["x"])]


def test_answers():
    row = {"doc_id": "d", "page": 1, "chunk_id": "c", "text": "The grey van left the harbour at 10:30."}
    graph = [{"source_name": "Ann", "target_name": "Depot", "relation_type": "OBSERVED_AT", "doc_id": "d", "page": 2, "chunk_id": None, "text": "Ann reached the Depot"}, {"source_name": "Depot", "target_name": "Bob", "relation_type": "OBSERVED_AT", "doc_id": "e", "page": 1, "chunk_id": None, "text": "Bob left the Depot"}]
    packet = {"chunks": [row], "graph_evidence": graph, "exact_matches": [], "negative_evidence": [{"doc_id": "n", "page": 4, "text": "He denied knowing Ann"}], "relationships": [{"source_name": "Ann", "target_name": "Depot", "relation_type": "OBSERVED_AT", "confidence": 0.9, "doc_count": 1}]}
    found = answers.claims_of("- grey van left harbour [d, p. 1]\n- purple ships vanish [d, p. 1]\n- uncited line", packet)
    checked = answers.validate([*found, {"text": "He denied knowing Ann", "citations": []}, {"text": "free", "citations": []}], packet)
    assert [c["status"] for c in checked] == ["SUPPORTED", "UNSUPPORTED", "SUPPORTED", "UNSUPPORTED"] and checked[3]["confidence"] == 0.1
    assert answers.render("x", checked).count("\n- ") == 1 and "2 claim(s) withheld" in answers.render("x", checked)
    assert [h["span_text"] for h in answers.hops("Ann met Bob", graph)] == ["Ann reached the Depot", "Bob left the Depot"]
    assert "Ann observed at Depot [d, p. 2]" in answers.deterministic({"intent": "entity_relationship_query", "entities": []}, packet)
    out = answers.redact(packet, {"Ann": "PERSON"})
    assert out["relationships"][0]["source"] == "PERSON" and out["relationships"][0]["target"] == "ENTITY"
    assert answers.briefing(checked)["confidence"] == "MEDIUM" and len(answers.summary_rows([row] * 9)) == 3


def test_report(spark, sf):
    g = trade_graph(spark, sf)
    mentions = g.evidence.select("doc_id", F.explode(F.split("rel_id", r"\|")).alias("entity_id"))
    events = spark.createDataFrame([("1996-01-02", "it left", "order-1.txt", 3), ("1995-05-05", "it came", None, None)], "event_time string, text string, doc_name string, page int")
    got = report.case_report(g, "1-urgent", mentions, g.evidence.select("doc_id"), events, case_name="Urgent", generated_at="today", answer=" All is well. ")
    page = got["markdown"]
    assert got["metrics"]["documents"] > 0 and got["metrics"]["locations"] == 0 and len(got["register"]) == 24 and len(got["pagerank"]) == 8 and len(got["facts"]) == 12
    assert page.startswith("# Case Intelligence Report: 1-urgent\n\n- Generated: today\n- Case reference: 1-urgent\n- Case name: Urgent\n- Documents indexed: ")
    heads = [line for line in page.splitlines() if line.startswith("#")]
    assert heads[1:] == ["## Executive Briefing", "## Graph Overview", "### Central Actors", "### Communities", "## Timeline", "## Key Facts", "## Document Register"]
    assert "\nAll is well.\n" in page and page.index("- 1995-05-05: it came\n") < page.index("- 1996-01-02: it left [order-1.txt, p.3]\n")
    assert len(got["groups"]) <= 6 and all(f"- Cluster {x['community_id'] + 1}: {x['size']} members. " in page for x in got["groups"])
    scores = [r.score for r in got["pagerank"]]
    assert scores == sorted(scores, reverse=True) and got["graph"]["node_count"] > 8 and got["graph"]["edge_count"] > 8


def test_report_of_a_case_without_anything(spark, sf):
    g = trade_graph(spark, sf)
    got = report.case_report(g, "nothing", g.evidence.select("doc_id", F.lit("x").alias("entity_id")), g.evidence.select("doc_id"))
    assert got["metrics"] == {"documents": 0, "entities": 0, "relationships": 0, "locations": 0}
    assert got["markdown"].count("No ") == 5 and got["markdown"].endswith("- No documents indexed for this case.\n")


def test_evaluation(spark, tmp_path):
    path = tmp_path / "f.json"
    cases = [{"name": "a", "query": "q", "expected_doc_ids": ["d1", "d2"], "expected_supported_claims": ["the van left"]}, {"name": "b", "query": "r", "expected_doc_ids": []}]
    path.write_text(json.dumps({"cases": cases}))
    c = evaluation.load_fixture(spark, str(path))
    r = evaluation.retrieval_recall(c, spark.createDataFrame([("a", "d1"), ("a", "d9")], "query_id string, doc_id string"))
    g = evaluation.grounded_recall(c, spark.createDataFrame([("a", "So The van LEFT early")], "query_id string, text string"))
    assert {x.query_id: x.recall for x in r.collect()} == {"a": 0.5, "b": 1.0} and evaluation.averages(r, g) == [0.75, 1.0]


def test_tables_as_text(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("subject;phone;note\nAnn;077;\n;;\nBob;;\"a;b\"\n")
    got = [tuple(r) for r in tabular.read_rows(spark, str(path)).orderBy("page").collect()]
    assert got == [(1, "subject: Ann | phone: 077", 5), (3, "subject: Bob | note: a;b", 5)]
    assert tabular.read_rows(spark, str(path), max_rows=1).count() == 1 and tabular.sniff("plain") == ","


def test_threads(spark, tmp_path):
    messages = [{"sender": "Ann <Ann@x.example>", "recipients": ["Bob [bob@y.example]"], "timestamp": "2024-01-02 03:04:05", "subject": "s", "body": "b" * 300}, {"sender": "bob@y.example", "recipients": ["bob@y.example", "ann@x.example"], "timestamp": "bad", "subject": None, "body": None}]
    rows = [("t1", "f", "subj", json.dumps(messages)), ("t2", "f", "subj", '{"sender": "x"}'), ("t3", "f", "subj", "not json"), ("t4", "f", "subj", None)]
    spark.createDataFrame(rows, "thread_id string, source_file string, subject string, messages string").write.parquet(str(tmp_path / "t"))
    got = threads.message_text(threads.read_threads(spark, str(tmp_path / "t"))).orderBy("page").collect()
    assert [(r.filename, r.page, r.subject) for r in got] == [("f#thread=t1", 1, "s"), ("f#thread=t1", 2, "subj")]
    assert got[0].event_time is not None and got[1].event_time is None and len(got[0].span_text) == 220 and "From: Ann" in got[0].text
    edges = threads.message_edges(threads.read_threads(spark, str(tmp_path / "t"))).collect()
    assert sorted((r.sender, r.recipient) for r in edges) == [("Ann <Ann@x.example>", "Bob [bob@y.example]"), ("bob@y.example", "ann@x.example")]
    df = spark.createDataFrame([("Ann <Ann@x.example>",), ("Bob [bob@y.example]",), ("c@z.example",), ("Just Name",)], "t string")
    assert [tuple(r) for r in df.select(threads.address(F.col("t")), threads.label(F.col("t"))).collect()] == [("ann@x.example", "Ann"), ("bob@y.example", "Bob"), ("c@z.example", "c@z.example"), ("", "Just Name")]


def test_mail_files(spark, tmp_path):
    m = EmailMessage()
    m["From"], m["To"], m["Cc"], m["Subject"], m["Date"] = "a@x.example", "b@y.example", "c@z.example", "Hi", "Tue, 3 Mar 2020 10:11:12 +0000"
    m.set_content("<p>Hello <b>you</b></p>", subtype="html")
    m.add_attachment(b"x", maintype="application", subtype="octet-stream", filename="x.bin")
    (tmp_path / "m.eml").write_bytes(bytes(m))
    r = threads.read_mail(spark, str(tmp_path)).first()
    assert r.recipients == ["b@y.example", "c@z.example"] and r.body == "Hello you" and r.attachments == ["x.bin"] and r.event_time.year == 2020


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one\x00page")
    (tmp_path / "b.csv").write_bytes(b"x")
    got = {r.kind: r for r in files.fingerprints(spark, str(tmp_path)).collect()}
    assert set(got) == {"pdf", "table"} and got["table"].source_size_bytes == 1
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    pages = files.extract_pages(raw, lambda p, c: [(1, c.decode())] if p.endswith("PDF") else []).collect()
    assert [(r.page, r.text, r.needs_ocr) for r in pages] == [(1, "onepage", True)] and files.extract_pages(raw).count() == 0
    one = spark.range(1)
    assert one.select(files.decimal_degrees(F.lit(51), F.lit(30), F.lit(0.0), F.lit("S"), 90), files.decimal_degrees(F.lit(99), F.lit(0), F.lit(0), F.lit("N"), 90)).first() == (-51.5, None)
    assert one.select(files.infer_case(F.lit("NF-1.pdf")), files.infer_case(F.lit("x"))).first() == ("OP_NIGHTFALL", "UNASSIGNED")
    assert one.select(*files.ocr_quality(F.array(F.lit(50.0), F.lit(90.0), F.lit(-1.0))), *files.ocr_quality(F.array().cast("array<double>"))).first() == (0.7, False, None, True)
    rects = spark.createDataFrame([("d", 1, 9.0, 9.0, 0.0), ("d", 1, 9.0, 2.0, 0.0), ("d", 1, 9.0, 9.0, 0.5)], "doc_id string, page int, width double, height double, fill double")
    assert files.redaction_boxes(rects).first().redactions == 1


def test_streaming(spark, tmp_path):
    from casewright.streaming import ingest as live

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "source_hash string, text string"
    spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b")], schema).write.parquet(src)
    for n, rows in ((1, []), (2, [("h2", "b"), ("h3", "c")])):
        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        q = live.ingest_new(live.read_documents(spark, src, schema), out, str(tmp_path / "check"))
        q.awaitTermination(60)
    assert sorted(r.source_hash for r in spark.read.parquet(out).collect()) == ["h1", "h2", "h3"]


def test_schemas(spark):
    assert schemas.empty(spark, "cases").count() == 0
    got = schemas.conform(spark.createDataFrame([("1", "x")], "case_id string, other string"), "cases")
    assert got.columns == ["case_id", "case_ref", "case_name", "created_at"]
