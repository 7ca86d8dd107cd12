import datetime as dt
import random
from collections import deque

import duckdb
from pyspark.sql import functions as F

from casewright import catalog
from casewright.operators import enrich, extract, inventory, retrieve, tools, walk


def brute_paths(rels, source, target, hops, most):
    near = {}
    for r, s, t, c in rels:
        near.setdefault(s, []).append((-c, r, t))
        if s != t:
            near.setdefault(t, []).append((-c, r, s))
    queue, seen, out = deque([(source, [source], [])]), {source}, []
    while queue and len(out) < most:
        x, path, ids = queue.popleft()
        if len(ids) >= hops:
            continue
        for _, r, y in sorted(near.get(x, [])):
            if y == target:
                out.append((">".join([*path, y]), ",".join([*ids, r]), len(ids) + 1))
            elif y not in seen:
                seen.add(y)
                queue.append((y, [*path, y], [*ids, r]))
    return out[:most]


def test_evidence_paths(spark):
    rnd = random.Random(4)
    rels = [(f"r{i:02d}", *rnd.sample("abcdefgh", 2), round(rnd.random(), 3)) for i in range(16)]
    df = spark.createDataFrame(rels, "rel_id string, source_entity string, target_entity string, confidence double")
    for a, b, hops in (("a", "h", 4), ("c", "d", 3), ("b", "e", 1)):
        got = [tuple(r) for r in walk.evidence_paths(df, a, b, hops, 5).collect()]
        assert got == brute_paths(rels, a, b, hops, 5)


def test_neighbours(spark):
    df = spark.createDataFrame([("r1", "a", "b", 0.9), ("r2", "b", "c", 0.8), ("r3", "c", "d", 0.7), ("r4", "a", "c", 0.1)], "rel_id string, source_entity string, target_entity string, confidence double")
    assert [r.rel_id for r in walk.neighbours(df, "a").collect()] == ["r1", "r4"]
    assert [(r.rel_id, r.hop) for r in walk.neighbours(df, "a", depth=2).collect()] == [("r1", 1), ("r4", 1), ("r2", 2), ("r3", 2)]


def test_model_replies():
    text = "Anna Hart met Ben at the dock"
    reply = '```json\n[{"text": "anna hart", "entity_type": "person", "confidence": 2}, {"text": "ANNA HART", "entity_type": "PERSON"}, {"text": "Zed", "entity_type": "PERSON"}, {"text": "dock", "entity_type": "meeting place", "confidence": "x"}, 5]\n```'
    assert enrich.model_entities(reply, text) == [("Anna Hart", "PERSON", 0, 9, 0.95), ("dock", "MEETING_PLACE", 25, 29, 0.5)]
    assert enrich.model_entities("no json", text) == [] and enrich.model_entities('{"a": 1}', text) == []
    rel = enrich.model_relations('[{"source": "Anna", "target": "Ben", "relation_type": "met with", "span_text": "met Ben", "confidence": 0}, {"relation_type": "?", "span_text": "absent"}]', text)
    assert rel[0] == ("Anna", "Ben", "MET_WITH", 0.1, 10, 17, "met Ben", "llm") and rel[1][2:6] == ("INFERRED_LINK", 0.5, 0, 0)


def test_geocodes(spark):
    places = spark.createDataFrame([("a", "x  cr02ab road cr02ab", 1), ("b", "here", 2), ("c", "nowhere", 3), ("d", "broken", 1)], "entity_id string, canonical_name string, mention_count int")
    cache = spark.createDataFrame([("b", 1.0, 2.0, "B"), ("c", None, None, None)], "entity_id string, latitude double, longitude double, display_name string")

    def lookup(q):
        if q == "broken":
            raise OSError
        return (5.0, 6.0, q) if "CR0 2AB" in q else None

    got = {r.entity_id: r for r in enrich.geocode(places, cache, lookup).collect()}
    assert {k: v.status for k, v in got.items()} == {"a": "hit", "b": "cached", "c": "miss", "d": "miss"} and got["a"].display_name == "x CR0 2AB road cr02ab"
    assert {r.status for r in enrich.geocode(places, cache, lookup, force=True).collect()} == {"hit", "miss"}


def test_people_of_addresses(spark):
    aliases = spark.createDataFrame([("2", "e2", "Ann@x.example"), ("1", "e1", "ann@x.example")], "alias_id string, entity_id string, alias_text string")
    senders = spark.createDataFrame([("Ann <ann@X.example>",), ("Ben <ben@y.example>",), ("Cy",)], "raw string")
    assert {r.raw: (r.label, r.entity_id) for r in enrich.people_of_addresses(senders, aliases).collect()} == {"Ann <ann@X.example>": ("Ann", "e1"), "Ben <ben@y.example>": ("Ben", None), "Cy": ("Cy", None)}


def test_inventory_of_phones(spark):
    e = spark.createDataFrame([("p1", "+447712345678", "PHONE"), ("p2", "+447700000000", "PHONE"), ("p3", "123", "PHONE"), ("l1", "to the sea", "LOCATION"), ("l2", "Dover", "LOCATION")], "entity_id string, canonical_name string, entity_type string")
    m = spark.createDataFrame([("p1", "077", "d1", "c1", "1"), ("p2", "078", "d1", "c2", "2"), ("p3", "1", "d1", "c1", "3"), ("l1", "to the sea", "d1", "c1", "4"), ("l2", "Dover", "d1", "c1", "5"), ("l2", "DOVER", "d2", "c2", "6")], "entity_id string, alias_text string, doc_id string, chunk_id string, alias_id string")
    c = spark.createDataFrame([("c1", 1, "the Phone rang", "f1"), ("c2", None, "invoice", "f2")], "chunk_id string, page int, text string, filename string")
    assert [r.entity_id for r in inventory.inventory(e, m, "PHONE", c).collect()] == ["p1"]
    assert [(r.entity_id, r.doc_count, r.aliases) for r in inventory.inventory(e, m, "LOCATION").collect()] == [("l2", 2, "DOVER, Dover")]
    assert [(r.entity_id, r.page, r["rank"]) for r in inventory.best_citations(m, c).where("entity_id = 'l2'").orderBy("rank").collect()] == [("l2", 1, 1), ("l2", None, 2)]


def test_small_pieces(spark):
    one = spark.range(1)
    assert one.select(enrich.transcript(F.lit(" hi "), "m"), enrich.transcript(F.lit(" "))).first() == ("[Transcript via m]\nhi", None)
    assert one.select(*enrich.image_text(F.lit(None).cast("string"), F.lit(1.5), F.lit(-2.0), F.lit("x.png"))).first() == ("x.png\n[GPS: 1.500000, -2.000000]", True)
    row = enrich.event_row(spark, event_id="e", status="success", started_at=dt.datetime(2024, 1, 1), completed_at=dt.datetime(2024, 1, 1, 0, 0, 2)).first()
    assert row.duration_ms == 2000 and row.notes is None
    cards = inventory.cards(spark.createDataFrame([("k1", "d", 1, "t"), ("k2", "d", 1, "t"), ("k1", "d", 2, " ")], "claim_id string, doc_id string, page int, text string")).collect()
    assert [(r.page, r.claims) for r in cards] == [(1, ["k1", "k2"])]
    at = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "entity_id string, uploaded_at int, attachment_id string")
    assert {r.attachment_id for r in enrich.latest_attachment(at).collect()} == {"y", "z"}
    assert tools.store_health(spark)["tables"] >= 0


def test_learned_ranking(spark):
    rows = [("q", "fts", "k1", "d1", 9.0, 1), ("q", "vector", "k2", "d1", 0.5, 1)]
    ranked = retrieve.fuse(spark.createDataFrame(rows, "query_id string, source string, key string, doc_id string, score double, ordinal int"))
    got = {r.key: r.rank_score for r in retrieve.learned(ranked, lambda f: -f["base_score"]).collect()}
    assert got == {"k1": -9.0, "k2": -0.5}


def test_fetch_and_timeline(spark):
    import pytest

    docs = spark.createDataFrame([("d1", "A"), ("d2", "B")], "doc_id string, case_ref string")
    rows = spark.createDataFrame([("d1", 1, "c1", "seen 2 May 2024 at 10:00 there"), ("d2", 1, "c2", "on 1/4/2024"), ("d2", 2, "c3", "no date"), ("d2", 3, "c4", "in May 2020")], "doc_id string, page int, chunk_id string, text string")
    assert tools.fetch_chunk(tools.Scope("case", case_ref="A"), docs, rows, "c1")["page"] == 1 and tools.fetch_chunk(tools.Scope(), docs, rows, "zz") is None
    with pytest.raises(tools.ScopeViolation):
        tools.fetch_chunk(tools.Scope("case", case_ref="A"), docs, rows, "c2")
    got = tools.text_timeline(rows, 10).collect()
    assert [r.chunk_id for r in got] == ["c2", "c1", "c4"] and got[2].event_time is None and "seen" in got[1].excerpt


def test_attach_and_scope_helpers(spark):
    ents = spark.createDataFrame([("1", "+447712345678"), ("2", "Marcus Webb")], "entity_id string, canonical_name string")
    assert {r.entity_id for r in retrieve.resolve_names(ents, ["07712 345678", "WEBB, MARCUS"]).collect()} == {"1", "2"}
    assert extract.relation_type("has-met") == "HAS_MET"


def test_walks_over_all_relationships(spark, sf):
    con = duckdb.connect()
    for t in ("customer", "supplier", "nation", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rels = con.sql(f"WITH {catalog.GRAPH} SELECT rel_id, source_entity, target_entity, confidence FROM rel").fetchall()
    near = {}
    for _, s, t, _ in rels:
        near.setdefault(s, set()).add(t)
        near.setdefault(t, set()).add(s)

    def depths(seeds, most):
        at = dict.fromkeys(seeds, 0)
        queue = deque(at)
        while queue:
            x = queue.popleft()
            for y in near[x] - set(at) if at[x] < most else ():
                at[y] = at[x] + 1
                queue.append(y)
        return at

    assert dict(catalog.khop_walk_nodes_all(spark, sf).collect()) == depths(["S1"], 3)
    inside = depths(["S2"], 2)
    assert sorted(map(tuple, catalog.induced_subgraph_all(spark, sf).collect())) == sorted(r[:3] for r in rels if r[1] in inside and r[2] in inside)
    least = {}
    for x in sorted(near):
        if x not in least:
            least |= dict.fromkeys(depths([x], len(near)), x)
    assert dict(catalog.connected_components_all(spark, sf).collect()) == least
    assert [tuple(r) for r in catalog.evidence_paths(spark, sf).collect()] == brute_paths(rels, "S1", "S2", 4, 5)
