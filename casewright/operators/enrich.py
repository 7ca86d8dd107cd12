"""What comes from outside: geocodes, attachments, replies of models, people behind mail addresses, event rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators.extract import Span, relation_type
from casewright.operators.store import latest
from casewright.registry import Registry, default_registry

#: The range that a model's confidence is held to.
LEAST, MOST = 0.10, 0.95
POSTCODE = r"(?i)\b([A-Z]{1,2}\d[A-Z\d]?)\s*(\d[A-Z]{2})\b"


def geocode_query(name: Column) -> Column:
    """White space folded; a postcode in capitals with its space, the first one only."""
    q = F.regexp_replace(F.trim(name), r"\s+", " ")
    found = F.regexp_extract(q, POSTCODE, 0)
    spaced = F.concat_ws(" ", F.upper(F.regexp_extract(q, POSTCODE, 1)), F.upper(F.regexp_extract(q, POSTCODE, 2)))
    at = F.instr(q, found)
    return F.when(found == "", q).otherwise(F.concat(F.substring(q, F.lit(1), at - 1), spaced, F.substring(q, at + F.length(found), F.length(q))))


def geocode(entities: DataFrame, cache: DataFrame, lookup: Callable[[str], tuple[float, float, str] | None] | None = None, force: bool = False) -> DataFrame:
    """``entity_id, latitude, longitude, display_name, status``: cached, hit or miss. Without a hook nothing is looked up.

    entities: LOCATION rows ``entity_id, canonical_name, mention_count``; cache: ``entity_id, latitude, longitude, display_name``.
    """
    held = entities.join(cache.where("latitude is not null"), "entity_id", "inner").select("entity_id", "latitude", "longitude", "display_name", F.lit("cached").alias("status"))
    asked = entities if force else entities.join(cache.where("latitude is not null"), "entity_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for e, q in zip(b["entity_id"], b["q"], strict=True):
                try:
                    got = lookup(q) if lookup else None
                except Exception:  # a failed look-up is a miss
                    got = None
                rows.append((e, *(got or (None, None, None)), "hit" if got else "miss"))
            yield pd.DataFrame(rows, columns=["entity_id", "latitude", "longitude", "display_name", "status"])

    new = asked.select("entity_id", geocode_query(F.col("canonical_name")).alias("q")).mapInPandas(run, "entity_id string, latitude double, longitude double, display_name string, status string")
    return new if force else held.unionByName(new)


def latest_attachment(attachments: DataFrame) -> DataFrame:
    return latest(attachments, ["entity_id"], [F.desc("uploaded_at"), F.desc("attachment_id")])


def _listed(reply: str) -> list[dict]:
    try:
        got = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", reply.strip()))
    except ValueError:
        return []
    return [x for x in got if isinstance(x, dict)] if isinstance(got, list) else []


def _sure(x) -> float:
    try:
        return min(MOST, max(LEAST, float(x)))
    except (TypeError, ValueError):
        return 0.5


def model_entities(reply: str, text: str, registry: Registry | None = None) -> list[Span]:
    """Spans from a model's JSON reply: only names that stand in the text, each once."""
    registry, out, seen = registry or default_registry(), [], set()
    for x in _listed(reply):
        surface, kind = str(x.get("text", "")).strip(), registry.canonical_type(str(x.get("entity_type", "")))
        at = text.lower().find(surface.lower()) if surface else -1
        if at < 0 or not re.fullmatch(r"[A-Z][A-Z0-9_]{1,39}", kind):
            continue
        key = (surface.lower(), kind, at)
        if key not in seen:
            seen.add(key)
            out.append((text[at : at + len(surface)], kind, at, at + len(surface), _sure(x.get("confidence", 0.5))))
    return out


def model_relations(reply: str, text: str) -> list[tuple]:
    """Relations from a model's JSON reply; a span that the text does not have gets the offsets 0 and 0."""
    out = []
    for x in _listed(reply):
        span = str(x.get("span_text", ""))
        at = text.find(span) if span else -1
        out.append((str(x.get("source", "")), str(x.get("target", "")), relation_type(str(x.get("relation_type", ""))), _sure(x.get("confidence", 0.5)), max(at, 0), at + len(span) if at >= 0 else 0, span or text[:100], "llm"))
    return out


def people_of_addresses(senders: DataFrame, aliases: DataFrame) -> DataFrame:
    """``raw, email, label, entity_id``: the entity whose alias is the sender's address, the first by alias id; else null.

    senders: ``raw``; those left with null are resolved by name.
    """
    from casewright.sources.threads import address, label

    parts = senders.select("raw", address(F.col("raw")).alias("email"), label(F.col("raw")).alias("label")).distinct()
    known = latest(aliases.withColumn("email", F.lower("alias_text")), ["email"], [F.asc("alias_id")]).select("email", "entity_id")
    return parts.join(known, "email", "left").select("raw", "email", "label", F.when(F.col("email") != "", F.col("entity_id")).alias("entity_id"))


def transcript(text: Column, model: str = "model") -> Column:
    """A transcript under its heading; null where nothing was said, for the status ``transcription_empty``."""
    said = F.trim(F.coalesce(text, F.lit("")))
    return F.when(said != "", F.concat(F.lit(f"[Transcript via {model}]\n"), said))


def image_text(ocr: Column, latitude: Column, longitude: Column, filename: Column, least: int = 20) -> tuple[Column, Column]:
    """(text, whether OCR failed): the recognised text with its position, the file's name where there is none."""
    said = F.trim(F.coalesce(ocr, F.lit("")))
    place = F.when(latitude.isNotNull() & longitude.isNotNull(), F.format_string("\n[GPS: %.6f, %.6f]", latitude, longitude)).otherwise("")
    return F.concat(F.when(said == "", filename).otherwise(said), place), F.length(said) < least


def event_row(spark, **values) -> DataFrame:
    """One row of ``ingestion_events``; the duration follows from its times."""
    from casewright.schemas import schema_of

    start, end = values.get("started_at"), values.get("completed_at")
    if start and end:
        values.setdefault("duration_ms", int((end - start).total_seconds() * 1000))
    schema = schema_of("ingestion_events")
    return spark.createDataFrame([tuple(values.get(n) for n in schema.names)], schema)
