"""Ingest: pages to chunks, mentions, resolved entities, relationships and evidence, as one chain of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright import config
from casewright.functions import normalise, text
from casewright.operators import extract, resolve
from casewright.registry import Registry, default_registry
from casewright.schemas import conform, stable_id
from casewright.session import cut_lineage


@dataclass
class Ingested:
    documents: DataFrame
    chunks: DataFrame
    entities: DataFrame
    entity_aliases: DataFrame
    relationships: DataFrame
    relationship_evidence: DataFrame
    page_quality: DataFrame

    def write(self, folder: str, mode: str = "append") -> None:
        for name, df in vars(self).items():
            df.write.mode(mode).parquet(f"{folder}/{name}")


def ingest_pages(pages: DataFrame, registry: Registry | None = None, models: tuple[Callable, ...] = (), relation_model: Callable | None = None, target: int = config.CHUNK_TOKENS, overlap: int = config.CHUNK_OVERLAP) -> Ingested:
    """pages: ``doc_id, case_id, filename, page, text``. Resolution is the only step that needs rows of other documents."""
    registry = registry or default_registry()
    clean = pages.withColumn("text", text.clean(F.col("text")))
    chunks = text.chunk_windows(clean.select("doc_id", "page", "text"), target, overlap).withColumn("chunk_id", stable_id("doc_id", F.col("chunk_index").cast("string")))
    found = cut_lineage(extract.relations(extract.mentions(chunks, registry, models), registry, relation_model))
    one = found.select("doc_id", "chunk_id", "page", F.posexplode("mentions").alias("position", "m")).select("doc_id", "chunk_id", "page", "position", F.col("m.text").alias("surface"), F.col("m.entity_type").alias("entity_type"), F.col("m.confidence").alias("confidence"))
    named = one.withColumn("name", normalise.normalise(F.col("surface"), F.col("entity_type"), registry)).where("name != ''")
    seen = F.concat_ws("/", "doc_id", F.lpad("page", 8, "0"), F.lpad("position", 6, "0"))
    done = cut_lineage(resolve.resolve(named.select("entity_type", "name", seen.alias("seen"))))
    of = named.join(done, ["entity_type", "name"]).withColumn("entity_id", stable_id("entity_type", "canonical_name"))
    aliases = of.select(stable_id("chunk_id", F.col("position").cast("string"), "surface").alias("alias_id"), "entity_id", F.col("surface").alias("alias_text"), F.col("doc_id").alias("source_doc"), F.col("chunk_id").alias("source_chunk"), F.col("score").alias("resolution_confidence"), F.col("method").alias("resolution_method"), F.when(F.col("method") == "jaro_winkler", F.col("entity_id")).alias("matched_entity_id"))
    entities = of.groupBy("entity_id", "canonical_name", "entity_type").agg(F.min_by("doc_id", "page").alias("first_seen_doc"), (F.count(F.lit(1)) + 1).cast("int").alias("mention_count"), F.max("confidence").alias("confidence"))
    said = found.select("doc_id", "chunk_id", "page", F.posexplode("relations").alias("n", "r")).select("doc_id", "chunk_id", "page", "n", "r.*")
    joined = extract.attach_entities(said, of.select("chunk_id", "surface", "entity_id", "position"))
    rels = joined.withColumn("rel_id", stable_id("chunk_id", F.col("n").cast("string")))
    evidence = rels.select(stable_id("rel_id", F.lit("evidence")).alias("evidence_id"), "rel_id", "chunk_id", "doc_id", "page", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("text").alias("span_text"), F.col("method").alias("extraction_method"))
    quality = clean.select("doc_id", "page", F.lit("text").alias("extraction_method"), text.redactions(F.col("text")).cast("int").alias("redaction_count")).withColumn("evidence_gap", F.col("redaction_count") > 0).withColumn("needs_review", F.lit(False)).withColumn("notes", F.when(F.col("evidence_gap"), "redaction markers detected").otherwise(""))
    documents = pages.groupBy("doc_id", "case_id", "filename").agg(F.count_distinct("page").cast("int").alias("page_count")).withColumn("classification", F.lit("OFFICIAL")).withColumn("format", F.lit("pdf"))
    return Ingested(conform(documents, "documents"), conform(chunks, "chunks"), conform(entities, "entities"), conform(aliases, "entity_aliases"), conform(rels, "relationships"), conform(evidence, "relationship_evidence"), conform(quality, "document_page_quality"))
