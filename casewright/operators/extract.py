"""Entities and relations from text: rules with offsets, overlaps, precedence, relation patterns, co-occurrence."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.registry import WORDS_OF, Registry, default_registry

MENTION = "array<struct<text:string,entity_type:string,start:int,end:int,confidence:double>>"
Span = tuple[str, str, int, int, float]


def rule_spans(text: str | None, registry: Registry) -> list[Span]:
    """Spans of all rules without those inside another of their own type; vehicles in upper case."""
    found: list[Span] = []
    for t in registry.types.values():
        if not t.pattern:
            continue
        for m in re.finditer(t.pattern, text or "", re.IGNORECASE if t.ignore_case else 0):
            a, b = m.span(t.group)
            if a >= 0 and b > a:
                s = m.group(t.group)
                found.append((s.upper() if t.name == "VEHICLE" else s, t.name, a, b, 1.0))
    return drop_nested(found)


def drop_nested(spans: list[Span]) -> list[Span]:
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[2], s[2] - s[3])):
        if not any(k[1] == s[1] and k[2] <= s[2] and s[3] <= k[3] for k in kept):
            kept.append(s)
    return kept


def keep_surer(spans: list[Span]) -> list[Span]:
    """Of two spans that overlap one after the other, the one of strictly higher confidence, else the first."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[2], s[3])):
        if out and s[2] < out[-1][3]:
            if s[4] > out[-1][4]:
                out[-1] = s
        else:
            out.append(s)
    return out


def by_precedence(*sources: list[Span]) -> list[Span]:
    """Spans of all sources, first sources first, without those that overlap one that is in already."""
    out: list[Span] = []
    for s in (s for source in sources for s in source):
        if not any(s[2] < o[3] and o[2] < s[3] for o in out):
            out.append(s)
    return sorted(out, key=lambda s: (s[2], s[3]))


def mentions(chunks: DataFrame, registry: Registry | None = None, models: tuple[Callable[[str], list[Span]], ...] = ()) -> DataFrame:
    """``chunks`` with ``mentions``: rule spans, then those of each model hook that overlap none."""
    registry = registry or default_registry()

    @F.pandas_udf(MENTION)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: [dict(zip(("text", "entity_type", "start", "end", "confidence"), s, strict=True)) for s in by_precedence(rule_spans(t, registry), *[m(t or "") for m in models])])

    return chunks.withColumn("mentions", run("text"))


def rule_texts(text: Column, pattern: str, group: int = 1) -> Column:
    """A rule's matches without offsets, by built-in functions."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


RELATION = "array<struct<source:string,target:string,relation_type:string,confidence:double,start:int,end:int,text:string,method:string>>"


def pattern_relations(text: str | None, registry: Registry) -> list[tuple]:
    """What the patterns find; one is tried where the words that it has to find are in the text."""
    out = []
    for kind, pattern in registry.relations:
        if pattern in WORDS_OF and not re.search(WORDS_OF[pattern], text or "", re.IGNORECASE):
            continue
        for m in re.finditer(pattern, text or "", re.IGNORECASE):
            s, t = m.group("source").strip(), m.group("target").strip()
            if s and t and s != t:
                out.append((s, t, kind, 0.85, m.start(), m.end(), m.group(0), "pattern"))
    return out


def relation_type(name: str | None) -> str:
    """A model's relation type where it is a plain upper-case name, else INFERRED_LINK."""
    made = re.sub(r"[\s-]+", "_", (name or "").strip().upper())
    return made if re.fullmatch(r"[A-Z][A-Z0-9_]{1,39}", made) else "INFERRED_LINK"


def relations(found: DataFrame, registry: Registry | None = None, model: Callable[[str, list[str]], list[tuple]] | None = None) -> DataFrame:
    """``found`` (with text and mentions) with ``relations``: patterns, else the model's, else the first two mentions together."""
    registry = registry or default_registry()

    def one(text: str | None, entities) -> list[dict]:
        names = [e["text"] for e in (entities if entities is not None else [])]
        got = pattern_relations(text, registry) or (model(text or "", names) if model else [])
        if not got and len(names) >= 2:
            got = [(names[0], names[1], "MENTIONED_WITH", 0.35, 0, min(180, len(text or "")), (text or "")[:180], "co-occurrence")]
        return [dict(zip(("source", "target", "relation_type", "confidence", "start", "end", "text", "method"), g, strict=True)) for g in got]

    @F.pandas_udf(RELATION)
    def run(texts: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([one(t, e) for t, e in zip(texts, held, strict=True)])

    return found.withColumn("relations", run("text", "mentions"))


def attach_entities(relations_: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Relations with the ids of both ends by exact surface in the chunk, the last mention first; others and loops go.

    relations_: ``chunk_id, source, target, ...``; surfaces: ``chunk_id, surface, entity_id, position``.
    """
    last = F.row_number().over(Window.partitionBy("chunk_id", "surface").orderBy(F.desc("position")))
    one = surfaces.withColumn("r", last).where("r = 1").select("chunk_id", "surface", "entity_id")
    end = lambda side: one.select("chunk_id", F.col("surface").alias(side), F.col("entity_id").alias(f"{side}_entity"))
    return relations_.join(end("source"), ["chunk_id", "source"]).join(end("target"), ["chunk_id", "target"]).where("source_entity != target_entity")
