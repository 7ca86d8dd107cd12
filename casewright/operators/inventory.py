"""Inventories of one entity type: filters of odd names, counts, best citations, associations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators import edges, store

# How a place's name does not begin, what a chunk says near a telephone number, relation phrases.
NOT_PLACES = ["to ", "from ", "than ", "near ", "at ", "in ", "on "]
PHONE_WORDS = ["phone", "contact number", "msisdn", "call data", "telephony", "handset", "contacted", "calls", "tower", "cell site"]


def plausible_name(name: Column, entity_type: str) -> Column:
    """Whether a name can stand in an inventory of its type; the context of telephone numbers is checked apart."""
    low = F.lower(F.trim(name))
    if entity_type == "LOCATION":
        out = F.length(F.trim(name)) >= 4
        for start in NOT_PLACES:
            out = out & ~low.startswith(start)
        return out
    if entity_type == "PHONE":
        return F.length(F.regexp_replace(name, "[^0-9]", "")).between(10, 15) & ~low.startswith("number ending ")
    return F.lit(True)


def inventory(entities: DataFrame, mentions: DataFrame, entity_type: str, chunks: DataFrame | None = None, limit: int = 40) -> DataFrame:
    """Entities of a type with mentions, documents and joined aliases, by mentions, documents and name.

    mentions: ``entity_id, alias_text, doc_id, chunk_id``. A telephone number needs a chunk that speaks of telephones.
    """
    named = entities.where((F.col("entity_type") == entity_type) & plausible_name(F.col("canonical_name"), entity_type))
    if entity_type == "PHONE" and chunks is not None:
        said = F.lit(False)
        for w in PHONE_WORDS:
            said = said | F.lower("text").contains(w)
        near = mentions.join(chunks.where(said).select("chunk_id"), "chunk_id", "left_semi").select("entity_id")
        named = named.join(near, "entity_id", "left_semi")
    out = mentions.join(named, "entity_id").groupBy("entity_id", "canonical_name").agg(F.count(F.lit(1)).alias("mention_count"), F.count_distinct("doc_id").alias("doc_count"), F.array_join(F.array_sort(F.collect_set("alias_text")), ", ").alias("aliases"))
    return out.orderBy(F.desc("mention_count"), F.desc("doc_count"), "canonical_name", "entity_id").limit(limit)


def best_citations(mentions: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` pages of each entity, with the longest chunk of each, by page, nulls last, and file."""
    rows = mentions.join(chunks.select("chunk_id", "page", "text", "filename"), "chunk_id")
    one = store.latest(rows, ["entity_id", F.coalesce("filename", "doc_id"), "page"], [F.desc(F.length("text")), F.asc("alias_id")])
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.asc_nulls_last("page"), "filename", "alias_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= most)


def associated(relationships: DataFrame, evidence: DataFrame, of: DataFrame, most_rows: int | None = None, cited: DataFrame | None = None) -> DataFrame:
    """``node, neighbour, relation_type, confidence, citations``: all that each entity of ``of`` is linked to, in no order.

    ``most_rows``: only so many rows of an entity, surest first. cited: the relationships from both ends with their evidence, where
    the source deals them by node (``projection.Graph.ends``), in place of the first two.
    """
    from pyspark.sql.window import Window

    held = of.select(F.col("entity_id").alias("node"))
    if most_rows is None:
        rows = edges.adjacency(relationships).join(evidence.select("rel_id", "doc_id", "page"), "rel_id", "left") if cited is None else cited
        top = rows.join(held, "node", "left_semi")
    else:
        near = edges.adjacency(relationships).join(held, "node", "left_semi")
        # every relationship has a row at least, so the first rows are those of the first relationships: only these meet the evidence
        first = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("confidence"), "rel_id"))
        near = near.withColumn("r", first).where(F.col("r") <= most_rows).drop("r").join(evidence.select("rel_id", "doc_id", "page", "evidence_id"), "rel_id", "left")
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("confidence"), "rel_id", F.asc_nulls_last("evidence_id")))
        top = near.withColumn("r", rank).where(F.col("r") <= most_rows)
    return top.groupBy("node", "neighbour", "relation_type").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(F.struct("doc_id", "page"))).alias("citations"))


def associations(relationships: DataFrame, evidence: DataFrame, entities: DataFrame, of: DataFrame, most_rows: int | None = None) -> DataFrame:
    """As ``associated``, with name and type of the other end, by confidence, persons first."""
    out = associated(relationships, evidence, of, most_rows).join(entities.select(F.col("entity_id").alias("neighbour"), "canonical_name", "entity_type"), "neighbour")
    out = out.select("node", "neighbour", "canonical_name", "entity_type", "relation_type", "confidence", "citations")
    return out.orderBy("node", (F.col("entity_type") != "PERSON"), F.desc("confidence"), "neighbour")


def cards(spans: DataFrame) -> DataFrame:
    """Evidence cards: one for each document and page with a text, and the claims that cite it.

    spans: ``claim_id, doc_id, page, text``; blank texts go.
    """
    return spans.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("doc_id", "page").agg(F.min("text").alias("text"), F.array_sort(F.collect_set("claim_id")).alias("claims"))


def totals(**tables: DataFrame) -> DataFrame:
    """``table, rows`` for each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
