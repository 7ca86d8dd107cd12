"""The evidence model's tables as Spark schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "cases": "case_id string, case_ref string, case_name string, created_at timestamp_ntz",
    "documents": "doc_id string, case_id string, filename string, filepath string, classification string, format string, page_count int, ingested_at timestamp_ntz, ocr_used boolean, ocr_failed boolean, thumbnail_blob binary, source_hash string, source_size_bytes long, source_mtime_ns long, supersedes_doc_id string",
    "chunks": "chunk_id string, doc_id string, page int, chunk_index int, text string, token_count int, ingested_at timestamp_ntz",
    "entities": "entity_id string, canonical_name string, entity_type string, first_seen_doc string, mention_count int, confidence double, latitude double, longitude double, geocode_provider string, geocode_display_name string, geocoded_at timestamp_ntz, reviewed_at timestamp_ntz, reviewed_by string",
    "entity_aliases": "alias_id string, entity_id string, alias_text string, source_doc string, source_chunk string, resolution_confidence double, resolution_method string, matched_entity_id string",
    "relationships": "rel_id string, source_entity string, target_entity string, relation_type string, confidence double, first_evidenced timestamp_ntz, event_time timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz",
    "relationship_evidence": "evidence_id string, rel_id string, chunk_id string, doc_id string, page int, span_start int, span_end int, span_text string, extraction_method string, event_time timestamp_ntz",
    "queries": "query_id string, query_text string, intent string, llm_backend string, submitted_at timestamp_ntz",
    "answer_spans": "span_id string, query_id string, claim_text string, supporting_evidence array<string>, confidence double, validated boolean",
    "eval_runs": "id string, name string, started_at timestamp_ntz, completed_at timestamp_ntz, metrics_json string, fixture_path string",
    "document_page_quality": "doc_id string, page int, extraction_method string, ocr_confidence double, needs_review boolean, redaction_count int, evidence_gap boolean, notes string",
    "ingestion_events": "event_id string, case_id string, doc_id string, source_path string, source_type string, status string, error_message string, started_at timestamp_ntz, completed_at timestamp_ntz, duration_ms long, pages int, chunks int, entities_new int, relationships_new int, ocr_used boolean, notes string",
    "entity_attachments": "attachment_id string, entity_id string, filename string, mime_type string, file_size long, caption string, storage_path string, uploaded_at timestamp_ntz",
    "media_assets": "asset_id string, doc_id string, case_id string, filename string, filepath string, media_type string, duration_seconds double, created_at timestamp_ntz",
    "media_frames": "frame_id string, asset_id string, doc_id string, timestamp_seconds double, frame_index int, image_path string, description string, created_at timestamp_ntz",
    "media_detections": "detection_id string, frame_id string, asset_id string, doc_id string, label string, confidence double, description string, x1 double, y1 double, x2 double, y2 double, created_at timestamp_ntz",
    "media_object_relationships": "rel_id string, source_detection_id string, target_detection_id string, relation_type string, confidence double, frame_id string, asset_id string",
    "chunk_vectors": "chunk_id string, doc_id string, page int, text string, vector array<float>",
}


def schema_of(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with exactly the table's columns; missing ones are null, extra ones go. Older tables read the same way."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of(name).fields])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(name))


def stable_id(*parts) -> "F.Column":
    """A deterministic id from natural keys."""
    return F.sha2(F.concat_ws("|", *parts), 256)
