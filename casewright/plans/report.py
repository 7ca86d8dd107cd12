"""A case's report: figures, register, graph measures, timeline, key facts, and a page of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.operators import analytics, communities, edges
from casewright.projection import Graph


def metrics_by_case(graph: Graph, mentions: DataFrame) -> DataFrame:
    """``case_ref, documents, entities, relationships, locations`` of every case.

    mentions: ``entity_id, doc_id``. Entities and locations are those that the case's documents mention.
    """
    docs = graph.documents.select("case_ref", "doc_id")
    n = docs.groupBy("case_ref").agg(F.count(F.lit(1)).alias("documents"))
    # each entity once for a case before its type is looked up
    said = mentions.select("entity_id", "doc_id").distinct().join(docs, "doc_id").select("case_ref", "entity_id").distinct()
    place = F.count_if(F.upper("entity_type") == "LOCATION")
    ents = said.join(graph.entities.select("entity_id", "entity_type"), "entity_id", "left").groupBy("case_ref").agg(F.count(F.lit(1)).alias("entities"), place.alias("locations"))
    rels = graph.evidence.select("rel_id", "doc_id").distinct().join(docs, "doc_id").select("case_ref", "rel_id").distinct().groupBy("case_ref").agg(F.count(F.lit(1)).alias("relationships"))
    out = n.join(ents, "case_ref", "left").join(rels, "case_ref", "left")
    return out.select("case_ref", "documents", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("entities", "relationships", "locations")])


def register_by_case(documents: DataFrame, chunks: DataFrame, mentions: DataFrame, most: int | None = 24, fanned: bool = True) -> DataFrame:
    """``case_ref, place, doc_id, filename, page_count, chunk_count, entity_count``: each case's first documents by name.

    ``fanned``: chunks count once for each mention of the document, as where both are joined to it at once; else once. Both
    are counted by themselves, so nothing is multiplied as rows.
    """
    if most is not None:
        first = F.row_number().over(Window.partitionBy("case_ref").orderBy("filename", "doc_id"))
        documents = documents.withColumn("place", first).where(F.col("place") <= most)
    pages = F.coalesce(F.col("page_count"), F.lit(0)).cast("int") if "page_count" in documents.columns else F.lit(0)
    held = documents.select("doc_id")
    c = chunks.join(held, "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    m = mentions.join(held, "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), F.count_distinct("entity_id").alias("e"))
    out = documents.join(c, "doc_id", "left").join(m, "doc_id", "left")
    times = F.greatest(F.lit(1), F.coalesce("m", F.lit(0))) if fanned else F.lit(1)
    place = [F.col("place")] if most is not None else []
    return out.select("case_ref", *place, "doc_id", "filename", pages.alias("page_count"), (F.coalesce("c", F.lit(0)) * times).alias("chunk_count"), F.coalesce("e", F.lit(0)).alias("entity_count"))


def graph_pack(graph: Graph, case_ref: str, least: float = 0.35, most_ranked: int = 8, most_groups: int = 6) -> dict:
    """node_count and edge_count of the case's graph, its ranked entities, communities and modularity; lists are bounded."""
    flt = edges.EdgeFilter(case_ref=case_ref, min_confidence=least, exclude_types=("MENTIONED_WITH",))
    view = edges.edge_view(graph, flt)
    best = edges.best_edge_per_pair(view).select("source_entity", "target_entity", "weight")
    counted = view.agg(F.count(F.lit(1)).alias("edges")).first()
    nodes = view.select(F.explode(F.array("source_entity", "target_entity")).alias("node")).distinct().count()
    names = graph.entities.select(F.col("entity_id").alias("node"), "canonical_name", "entity_type")
    ranked = analytics.pagerank(best, rounds=15).join(names, "node").withColumn("score", F.round("rank", 6)).orderBy(F.desc("score"), "node").limit(most_ranked).collect()
    of = communities.louvain(best)
    ents = graph.entities if "mention_count" in graph.entities.columns else graph.entities.withColumn("mention_count", F.lit(0))
    rows = communities.report(of, ents.select("entity_id", "mention_count"), most=most_groups).join(names, "node").orderBy("community_id", "place").collect()
    groups: dict[int, dict] = {}
    for r in rows:
        groups.setdefault(r.community_id, {"community_id": r.community_id, "size": r.size, "members": []})["members"].append(r.canonical_name or r.node)
    score = analytics.modularity(best, of).first().modularity
    return {"node_count": nodes, "edge_count": counted.edges, "centrality": ranked, "communities": list(groups.values()), "modularity": score or 0.0}


def key_facts(graph: Graph, case_ref: str, most: int = 12) -> list[Row]:
    """The surest relationships that the case evidences: ``subject, predicate, object`` with their first citation."""
    docs = graph.documents.where(F.lower("case_ref") == case_ref.lower()).select("doc_id", "filename")
    cited = graph.evidence.join(docs, "doc_id")
    cited = cited.groupBy("rel_id").agg(F.min(F.struct(F.coalesce("page", F.lit(2**31 - 1)).alias("p"), "evidence_id", "doc_id", "filename", "page")).alias("c"))
    end = lambda side, name: graph.entities.select(F.col("entity_id").alias(side), F.col("canonical_name").alias(name))
    first = graph.relationships.join(cited, "rel_id").orderBy(F.desc("confidence"), "rel_id").limit(most)
    out = first.join(end("source_entity", "subject"), "source_entity").join(end("target_entity", "object"), "target_entity")
    return out.orderBy(F.desc("confidence"), "rel_id").select("subject", F.col("relation_type").alias("predicate"), "object", "confidence", F.col("c.filename").alias("doc_name"), F.col("c.page").alias("page")).collect()


# Headings and the lines of empty sections.
TITLE = "Case Intelligence Report"
EMPTY = {
    "Central Actors": "No centrality data available.", "Communities": "No community clusters available.", "Timeline": "No dated events were extracted for this case report.",
    "Key Facts": "No atomic facts extracted.", "Document Register": "No documents indexed for this case.",
}


def _section(level: int, name: str, lines: list[str]) -> list[str]:
    return ["", f"{'#' * level} {name}", "", *(lines or ([f"- {EMPTY[name]}"] if name in EMPTY else []))]


def markdown(case_ref: str, case_name: str | None, generated_at: str, answer: str, metrics: dict, register: list, pack: dict, timeline: list, facts: list) -> str:
    """The report as text; its parts are bounded lists."""
    head = [("Generated", generated_at), ("Case reference", case_ref), ("Case name", case_name or "Unknown"), *((f"{k.capitalize()} indexed", metrics[k]) for k in ("documents", "entities", "relationships", "locations"))]
    overview = [("Nodes in filtered graph", pack["node_count"]), ("Edges in filtered graph", pack["edge_count"]), ("Community modularity", pack["modularity"])]
    cite = lambda e: f" [{e['doc_name']}, p.{e['page'] or '?'}]" if e["doc_name"] else ""
    lines = [f"# {TITLE}: {case_ref}", "", *[f"- {k}: {v}" for k, v in head]]
    lines += _section(2, "Executive Briefing", [answer.strip()])
    lines += _section(2, "Graph Overview", [f"- {k}: {v}" for k, v in overview])
    lines += _section(3, "Central Actors", [f"- {r['canonical_name'] or r['node']} ({r['entity_type'] or '?'}) score {r['score']}" for r in pack["centrality"]])
    lines += _section(3, "Communities", [f"- Cluster {g['community_id'] + 1}: {g['size']} members. {', '.join(g['members'][:6])}" for g in pack["communities"]])
    lines += _section(2, "Timeline", [f"- {e['event_time']}: {e['text']}{cite(e)}" for e in timeline])
    lines += _section(2, "Key Facts", [f"- {f['subject']} {f['predicate']} {f['object']} [{f['doc_name']}, p.{f['page']}]" for f in facts])
    lines += _section(2, "Document Register", [f"- {d['filename']} ({d['page_count']} pages, {d['chunk_count']} chunks, {d['entity_count']} entities)" for d in register])
    return "\n".join(lines).rstrip() + "\n"


def case_report(graph: Graph, case_ref: str, mentions: DataFrame, chunks: DataFrame, timeline: DataFrame | None = None, case_name: str | None = None, generated_at: str = "", answer: str = "", most_docs: int = 24, most_events: int = 20) -> dict:
    """metrics, register, graph pack, timeline, facts (all bounded) and the report as markdown.

    timeline: ``event_time, text, doc_name, page`` of the case's dated events, the first ``most_events`` of which are shown.
    """
    docs = graph.documents.where(F.lower("case_ref") == case_ref.lower()).withColumn("case_ref", F.lit(case_ref))
    inside = Graph(graph.entities, graph.relationships, graph.evidence.join(docs.select("doc_id"), "doc_id", "left_semi"), docs)
    found = metrics_by_case(inside, mentions).drop("case_ref").first()
    metrics = found.asDict() if found else dict.fromkeys(("documents", "entities", "relationships", "locations"), 0)
    register = register_by_case(docs, chunks, mentions, most_docs).orderBy("place").collect()
    pack = graph_pack(graph, case_ref)
    events = timeline.orderBy("event_time", "doc_name", "page", "text").limit(most_events).collect() if timeline is not None else []
    facts = key_facts(inside, case_ref)
    text = markdown(case_ref, case_name, generated_at, answer, metrics, register, pack, events, facts)
    return {"metrics": metrics, "register": register, "pagerank": pack["centrality"], "groups": pack["communities"], "graph": pack, "timeline": events, "facts": facts, "markdown": text}


def low_confidence(entities: DataFrame, threshold: float = 0.50) -> DataFrame:
    """Entities that nobody has reviewed and that stay below the threshold, the least sure first."""
    return entities.where(F.col("reviewed_at").isNull() & (F.col("confidence") < threshold)).orderBy("confidence", "entity_id")
