"""The inventory of associations keeps every link and citation of an entity."""

import duckdb

from casewright import catalog, projection
from casewright.operators import inventory


def test_no_link_or_citation_is_dropped(spark):
    ents = spark.createDataFrame([("o", "o", "ORGANISATION")] + [(f"a{i:02}", f"A{i}", "PERSON") for i in range(20)], "entity_id string, canonical_name string, entity_type string")
    rels = spark.createDataFrame([(f"r{i:02}", "o", f"a{i:02}", "KNOWS", 0.5) for i in range(20)], "rel_id string, source_entity string, target_entity string, relation_type string, confidence double")
    seen = spark.createDataFrame([("r00", f"d{i:02}", 1, f"e{i:02}") for i in range(15)] + [("r01", "d1", None, "f")], "rel_id string, doc_id string, page int, evidence_id string")
    got = inventory.associations(rels, seen, ents, ents.where("entity_id = 'o'")).collect()
    assert [r.neighbour for r in got] == [f"a{i:02}" for i in range(20)]
    assert [r.doc_id for r in got[0].citations] == [f"d{i:02}" for i in range(15)] and [tuple(c) for c in got[1].citations] == [("d1", None)]


def test_the_query_gives_every_link(spark, sf):
    con = duckdb.connect()
    for name in ("customer", "supplier", "nation", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = catalog.association_inventory(spark, sf)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(con.execute(catalog.ORACLE["association_inventory"]).fetchall())
    g = projection.trade_graph(spark, sf)
    assert len(rows) == g.relationships.where("source_entity like 'S%' or target_entity like 'S%'").count()
    # as where the source deals nothing by node
    plain = inventory.associated(g.relationships, g.evidence, g.entities.where("entity_type = 'ORGANISATION'"))
    dealt = inventory.associated(g.relationships, g.evidence, g.entities.where("entity_type = 'ORGANISATION'"), cited=g.ends())
    assert plain.count() == dealt.count() == dealt.intersect(plain).count()
