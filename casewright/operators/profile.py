"""What is known about entities: documents, aliases, links with citations, dated sightings, tracks of vehicles.

Every function works on all entities, or on one where ``entity_id`` is given; its filter then comes before any shuffle.
Limits count per entity, through ``row_number``, which Spark applies before the shuffle too. Nulls: mentions without
entity or document count nowhere; a missing page or date comes last. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.functions import dates
from casewright.operators.edges import EdgeFilter, adjacency, edge_view
from casewright.projection import Graph


def _of(rows: DataFrame, entity_id: str | None, column: str = "entity_id") -> DataFrame:
    return rows.where(F.col(column).isNotNull()) if entity_id is None else rows.where(F.col(column) == entity_id)


def _first(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group, with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def _named(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows with the ``filename`` of their document, which is not joined where they carry it."""
    return rows if "filename" in rows.columns else rows.join(documents.select("doc_id", "filename"), "doc_id")


def aliases(mentions: DataFrame, entity_id: str | None = None, most: int = 100) -> DataFrame:
    """``entity_id, alias_text, rank``: distinct aliases in alphabetical order."""
    one = _of(mentions, entity_id).where("alias_text is not null").select("entity_id", "alias_text").distinct()
    return _first(one, "entity_id", [F.col("alias_text")], most)


def entity_documents(mentions: DataFrame, documents: DataFrame, entity_id: str | None = None, most: int = 100) -> DataFrame:
    """``entity_id, doc_id, filename, first_page, mention_count, rank``: the documents that mention an entity most.

    mentions: ``entity_id, doc_id, mention_id, page``, and where the source has them ``doc_key, filename`` of the document, which
    is then not joined. A mention that is there twice counts once.
    """
    carried = [c for c in ("doc_key", "filename") if c in mentions.columns]
    per = _of(mentions, entity_id).groupBy("entity_id", "doc_id", *carried).agg(F.min("page").alias("first_page"), F.count_distinct("mention_id").alias("mention_count"))
    named = _named(per, documents)
    return _first(named, "entity_id", [F.desc("mention_count"), F.col("filename"), F.col("doc_id")], most)


def _cited_ends(graph: Graph, entity_id: str | None) -> DataFrame:
    """Relationships from both ends, or from that of one entity, with their evidence and its file names."""
    rels = graph.relationships if entity_id is None else graph.relationships.where((F.col("source_entity") == entity_id) | (F.col("target_entity") == entity_id))
    ends = _of(adjacency(rels.select("source_entity", "target_entity", "rel_id", "relation_type", "confidence")), entity_id, "node")
    cited = graph.evidence.select("rel_id", "evidence_id", "doc_id", "page", "span_text").join(graph.documents.select("doc_id", "filename"), "doc_id", "left")
    return ends.join(cited, "rel_id", "left")


def links(graph: Graph, entity_id: str | None = None, most: int = 300) -> DataFrame:
    """``entity_id, rel_id, relation_type, confidence, linked_id, linked_name, linked_type, citations``.

    Of an entity's rows of relationship and evidence the ``most`` surest are taken, by page and file name; each
    relationship then has those of its citations that are among them. One without evidence has none. Where the graph has
    ``ends``, names are looked up for the rows that are taken.
    """
    order = [F.desc_nulls_last("confidence"), F.asc_nulls_last("page"), F.asc_nulls_last("filename"), F.col("rel_id"), F.col("evidence_id")]
    linked = graph.entities.select(F.col("entity_id").alias("neighbour"), F.col("canonical_name").alias("linked_name"), F.col("entity_type").alias("linked_type"))
    if graph.ends is not None:
        rows = _first(_of(graph.ends(), entity_id, "node"), "node", order, most).drop("evidence_id").join(linked, "neighbour")
    else:
        rows = _first(_cited_ends(graph, entity_id).join(linked, "neighbour"), "node", order, most)
    cite = F.when(F.col("doc_id").isNotNull(), F.struct("rank", "doc_id", "filename", "page", F.coalesce("span_text", F.lit("")).alias("span_text")))
    per = rows.groupBy(F.col("node").alias("entity_id"), "rel_id", "relation_type", "confidence", F.col("neighbour").alias("linked_id"), "linked_name", "linked_type")
    return per.agg(F.array_sort(F.collect_list(cite)).alias("citations"))


def sightings(mentions: DataFrame, documents: DataFrame, entity_id: str | None = None, most: int = 30) -> DataFrame:
    """``entity_id, seen_at, doc_id, filename, page, excerpt``: the first ``most`` mentions by document and page, if dated.

    mentions: ``entity_id, doc_id, page, text``, and ``filename`` where the source has it. A mention whose text has no readable date gives no row.
    """
    named = _named(_of(mentions, entity_id), documents)
    first = _first(named, "entity_id", [F.col("doc_id"), F.asc_nulls_last("page"), F.col("text")], most)
    dated = first.withColumn("seen_at", dates.parse(dates.first_date(F.coalesce("text", F.lit("")))))
    return dated.where("seen_at is not null").select("entity_id", "seen_at", "doc_id", "filename", "page", F.substring("text", 1, 280).alias("excerpt"))


def full_profile(graph: Graph, mentions: DataFrame, attachments: DataFrame, entity_id: str, timeline: int = 30) -> dict[str, DataFrame]:
    """The parts of an entity's profile; ``entity`` is empty where there is no such entity."""
    return {
        "entity": graph.entities.where(F.col("entity_id") == entity_id),
        "aliases": aliases(mentions, entity_id).orderBy("rank"),
        "documents": entity_documents(mentions, graph.documents, entity_id).orderBy("rank"),
        "links": links(graph, entity_id).orderBy(F.desc_nulls_last("confidence"), "rel_id"),
        "timeline": sightings(mentions, graph.documents, entity_id, min(200, timeline)).orderBy("seen_at", "doc_id"),
        "attachments": attachments_of(attachments, entity_id),
    }


def attachments_of(attachments: DataFrame, entity_id: str) -> DataFrame:
    """An entity's attachments, newest first."""
    return attachments.where(F.col("entity_id") == entity_id).orderBy(F.desc_nulls_last("uploaded_at"), "attachment_id")


def without_attachment(attachments: DataFrame, attachment_id: str) -> DataFrame:
    return attachments.where(~F.col("attachment_id").eqNullSafe(F.lit(attachment_id)))


def vehicle_track(graph: Graph, vehicle: str | None = None, most: int = 500) -> DataFrame:
    """Where vehicles were seen: ``vehicle, doc_id, filename, page, excerpt, place, place_name, latitude, longitude,
    relation_type, seen_at, position``.

    Evidence counts where its relationship is OBSERVED_AT or its text says ANPR or SIGHTING, and where the place is a
    geocoded LOCATION. The first ``most`` by document and page are taken; positions follow the date in the text,
    undated ones last. entities: also ``latitude, longitude``.
    """
    cars = _of(graph.entities.where(F.upper("entity_type") == "VEHICLE"), vehicle).select(F.col("entity_id").alias("node"))
    at = graph.entities.where((F.upper("entity_type") == "LOCATION") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    at = at.select(F.col("entity_id").alias("neighbour"), F.col("canonical_name").alias("place_name"), "latitude", "longitude")
    near = adjacency(graph.relationships.select("source_entity", "target_entity", "rel_id", "relation_type")).join(cars, "node", "left_semi").join(at, "neighbour")
    said = F.upper("span_text")
    seen = near.join(graph.evidence.select("rel_id", "evidence_id", "doc_id", "page", "span_text"), "rel_id")
    seen = seen.where((F.upper("relation_type") == "OBSERVED_AT") | said.contains("ANPR") | said.contains("SIGHTING")).join(graph.documents.select("doc_id", "filename"), "doc_id")
    kept = _first(seen, "node", [F.col("doc_id"), F.asc_nulls_last("page"), F.col("evidence_id")], most).drop("rank")
    excerpt = F.coalesce("span_text", F.lit(""))
    dated = kept.withColumn("seen_at", dates.parse(dates.first_date(excerpt)))
    position = F.row_number().over(Window.partitionBy("node").orderBy(F.asc_nulls_last("seen_at"), "doc_id", F.asc_nulls_last("page"), "evidence_id"))
    return dated.select(F.col("node").alias("vehicle"), "doc_id", "filename", "page", excerpt.alias("excerpt"), F.col("neighbour").alias("place"), "place_name", "latitude", "longitude", "relation_type", "seen_at", position.alias("position"))


def grouped_matches(matches: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Exact matches by entity: best score, aliases, documents and counts, the best first.

    matches: ``entity_id, mention_count, alias_text, doc_id, score``; those without entity go, missing scores count 0. With
    ``counts`` (``entity_id, mention_count``) the matches need no mention_count. Matches with ``doc_key`` are grouped by
    document first, where they lie already.
    """
    known = matches.where("entity_id is not null and entity_id != ''")
    by = [c for c in ("doc_key",) if c in matches.columns]
    said = None if counts is not None else F.max(F.coalesce("mention_count", F.lit(0)))
    per = known.groupBy("entity_id", F.coalesce("doc_id", F.lit("unknown")).alias("doc_id"), F.when(F.col("alias_text") != "", F.col("alias_text")).alias("alias_text"), *by)
    per = per.agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("n"), *([] if said is None else [said.alias("mention_count")]))
    per = per.groupBy("entity_id", "doc_id", *by).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("alias_text")).alias("said"), F.sum("n").alias("n"), *([] if said is None else [F.max("mention_count").alias("mention_count")]))
    docs = F.count(F.lit(1)) if by else F.count_distinct("doc_id")
    per = per.groupBy("entity_id").agg(
        F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("said")))).alias("aliases"), docs.alias("doc_count"), F.sum("n").alias("evidence_count"),
        *([] if said is None else [F.max("mention_count").cast("long").alias("mention_count")]),
    )
    if counts is not None:
        per = per.join(counts.select("entity_id", "mention_count"), "entity_id", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0)).cast("long"))
    per = per.select("entity_id", "score", "mention_count", "aliases", "doc_count", "evidence_count")
    return per.orderBy(F.desc("score"), F.desc("mention_count"), F.desc("doc_count"), F.desc("evidence_count"), "entity_id")


def network(graph: Graph, limit: int, flt: EdgeFilter = EdgeFilter()) -> DataFrame:
    """The ``limit`` surest relationships as an edge view; evidence is counted for these alone.

    Relationships with an end that is no entity are not in the view and take no place in the limit.
    """
    ends = graph.entities.select("entity_id")
    rels = flt.apply(graph)
    for side in ("source_entity", "target_entity"):
        rels = rels.join(ends, F.col(side) == F.col("entity_id"), "left_semi")
    top = rels.orderBy(F.desc_nulls_last("confidence"), "rel_id").limit(max(1, limit))
    evidence = graph.evidence.join(top.select("rel_id"), "rel_id", "left_semi")
    return edge_view(Graph(graph.entities, top, evidence, graph.documents))


def average_confidence(edges: DataFrame) -> DataFrame:
    """One row: ``edge_count, avg_confidence`` rounded to 3 places; 0.0 without edges, and a missing confidence counts 0."""
    mean = F.avg(F.coalesce("confidence", F.lit(0.0)))
    return edges.agg(F.count(F.lit(1)).alias("edge_count"), F.round(F.coalesce(mean, F.lit(0.0)), 3).alias("avg_confidence"))
