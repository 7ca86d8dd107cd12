"""The type registry: entity types with their rules, relation patterns, and how other registries are read.

The tables below are fixed values: names, patterns, word lists and codes that results depend on.
"""

from __future__ import annotations

import json
import logging
import re
from dataclasses import dataclass, field
from pathlib import Path

log = logging.getLogger(__name__)

# Titles, organisation suffixes and road abbreviations that normalisation takes out or expands.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "DC", "DCI", "DS", "DI", "Sgt", "PC", "Cst", "Det"]
SUFFIXES = ["Ltd", "Limited", "PLC", "Plc", "plc", "Inc", "Incorporated", "LLP", "LLC", "GmbH", "AG", "SA", "Pty", "Co"]
EXPANSIONS = {r"\bRd\.?\b": "Road", r"\bSt\.?\b": "Street", r"\bAve\.?\b": "Avenue", r"\bLn\.?\b": "Lane", r"\bBlvd\.?\b": "Boulevard", r"\bDr\.?\b": "Drive"}

# The patterns of the nine types that have one, with the group that counts and flags.
PATTERNS = {
    "LOCATION": (r"\b\d{1,4}\s+[A-Z][A-Za-z'-]+(?:\s+[A-Z][A-Za-z'-]+){0,3}\s+(?:Road|Street|Drive|Lane|Avenue|Close|Court|Way|Gardens|Crescent|Place|Park|Boulevard|Terrace|Square|Row|Highway|Freeway)\b", 0, ""),
    "PHONE": (r"(?<![\d])(\+?\d[\d\s().-]{8,}\d)(?![\d])", 1, ""),
    "VEHICLE": (r"\b([A-Z]{2}\s?\d{2}\s?[A-Z]{3}|[A-Z]{3}\s?\d{3,4}|\d{3}\s?[A-Z]{3}|[A-Z]{1,3}\s?\d{1,4}\s?[A-Z]{1,3})\b", 1, "i"),
    "CASE_REF": (r"\b(OP[_\-\s][A-Z0-9]+|URN[:\s]?[A-Z0-9\-/]+|\d{2}/[A-Z]{2,4}/\d+)\b", 1, "i"),
    "DATE": (r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}|(?:\d{1,2}\s+)?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}|\d{1,2}:\d{2}(?::\d{2})?)\b", 1, "i"),
    "EMAIL": (r"\b([A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,})\b", 1, ""),
    "IP_ADDRESS": (r"\b((?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?))\b", 1, ""),
    "BANK_ACCOUNT": (r"\b(GB\d{2}[A-Z]{4}\d{14}|(?:\d{2}-\d{2}-\d{2})\s+\d{8}|account(?:\s+number)?[:\s]+[A-Z0-9]{8,18}|card(?:\s+number)?[:\s]+(?:\d{4}[\s-]?){3}\d{4})\b", 1, "i"),
    "SERIAL": (r"\b(IMEI[:\s]*\d{15}|serial(?:\s+number)?[:\s]*[A-Z0-9-]{6,}|device\s+id[:\s]*[A-Z0-9-]{6,})\b", 1, "i"),
}

# Type, strategy, other names, display colour.
TYPES = [
    ("PERSON", "person", [], "#3a72c8"),
    ("ORGANISATION", "strip_suffix_title", ["ORG", "ORGANIZATION", "COMPANY"], "#7a4ab0"),
    ("LOCATION", "title_expand", ["PLACE", "ADDRESS", "GPE"], "#1a9a8a"),
    ("PHONE", "phone_e164", ["PHONE_NUMBER", "MOBILE", "TEL"], "#5a8a7a"),
    ("VEHICLE", "plate", ["LICENCE_PLATE", "LICENSE_PLATE", "REGISTRATION", "PLATE"], "#c96a00"),
    ("CASE_REF", "upper_snake", ["CASE", "CASE_NUMBER", "REFERENCE"], "#8899aa"),
    ("DATE", "trim", ["TIME", "DATETIME"], "#6b8cae"),
    ("EMAIL", "lower", ["EMAIL_ADDRESS"], "#c45c7a"),
    ("IP_ADDRESS", "trim", ["IP", "IPV4", "IPV6"], "#2a8f6f"),
    ("WEAPON", "trim", [], "#b03030"),
    ("DRUG", "trim", ["SUBSTANCE"], "#8a6a8a"),
    ("BANK_ACCOUNT", "upper_compact", ["BANK", "ACCOUNT", "IBAN", "CARD"], "#c9a227"),
    ("SERIAL", "upper_compact", [], "#9a6a4a"),
]

# Relation types, and patterns with the groups source and target; all ignore case.
RELATION_HINTS = ["OBSERVED_AT", "ASSOCIATED_WITH", "LINKED_TO", "MENTIONED_WITH", "INFERRED_LINK"]
RELATIONS = [
    ("OBSERVED_AT", r"(?P<source>[A-Z][\w.-]+(?:\s+[A-Z][\w.'-]+){0,3})\s+(?:was|were|is|are)\s+(?:observed|seen|spotted|sighted|photographed|recorded)\s+(?:at|near|in|outside|inside)\s+(?P<target>[^.;\n]{3,80}?)(?=[.;\n]|\s+at\s+\d{1,2}:\d{2})"),
    ("ASSOCIATED_WITH", r"(?P<source>[A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+){0,3})\s+(?:is|was|are|were)\s+(?:known\s+to\s+)?(?:associate[ds]?|meet(?:s|ing)?|working|collaborat(?:e|ing|es))\s+(?:with)\s+(?P<target>[A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+){0,3})"),
    ("ASSOCIATED_WITH", r"(?P<source>[A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+){0,3})\s+(?:and|with)\s+(?P<target>[A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+){0,3})\s+(?:were|are|was|is)\s+(?:together|seen together|present)"),
    ("LINKED_TO", r"(?P<source>[A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+){0,3})\s+(?:is|was|are|were)\s+(?:linked|tied|connected|related)\s+to\s+(?P<target>[^.;\n]{3,80}?)(?=[.;\n])"),
    ("LINKED_TO", r"(?P<source>[A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+){0,3})'s\s+(?:phone|number|mobile)\s+\(?(?P<target>\+?\d[\d\s().-]{8,}\d)\)?\s+(?:was|is|were)\s+(?:in\s+)?contact(?:ing|ed)?\s+with"),
]

# For each relation pattern the words between or after its names, which stand in every text that it matches.
# A name is any run of words, so the whole pattern is tried at every word; these are found far quicker and are looked for first.
RELATION_WORDS = [
    r"\s(?:was|were|is|are)\s+(?:observed|seen|spotted|sighted|photographed|recorded)\s+(?:at|near|in|outside|inside)\s",
    r"\s(?:is|was|are|were)\s+(?:known\s+to\s+)?(?:associate[ds]?|meet(?:s|ing)?|working|collaborat(?:e|ing|es))\s+(?:with)\s",
    r"\s(?:were|are|was|is)\s+(?:together|seen together|present)",
    r"\s(?:is|was|are|were)\s+(?:linked|tied|connected|related)\s+to\s",
    r"\s(?:was|is|were)\s+(?:in\s+)?contact(?:ing|ed)?\s+with",
]
WORDS_OF = {pattern: words for (_, pattern), words in zip(RELATIONS, RELATION_WORDS, strict=True)}


@dataclass(frozen=True)
class EntityType:
    name: str
    strategy: str = "trim"
    aliases: tuple[str, ...] = ()
    colour: str = "#888888"
    pattern: str | None = None
    group: int = 0
    ignore_case: bool = False
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Registry:
    types: dict[str, EntityType]
    relations: tuple[tuple[str, str], ...]
    hints: tuple[str, ...] = ()

    def canonical_type(self, name: str) -> str:
        """Upper-cased with underscores; other names of a type give that type, unknown ones stay."""
        asked = re.sub(r"[\s-]+", "_", name.strip().upper())
        if asked in self.types:
            return asked
        return next((t.name for t in self.types.values() if asked in t.aliases), asked)

    def listing(self) -> list[dict]:
        return [{"name": t.name, "colour": t.colour, "aliases": list(t.aliases), "strategy": t.strategy, "has_regex": t.pattern is not None} for t in sorted(self.types.values(), key=lambda t: t.name)]


def default_registry() -> Registry:
    made = {}
    for name, strategy, aliases, colour in TYPES:
        pattern, group, flags = PATTERNS.get(name, (None, 0, ""))
        made[name] = EntityType(name, strategy, tuple(aliases), colour, pattern, group, "i" in flags)
    return Registry(made, tuple(RELATIONS), tuple(RELATION_HINTS))


def load_registry(path: str | None) -> Registry:
    """A registry from a JSON file. A missing or broken file gives an empty registry; broken entries are left out."""
    if path is None:
        return default_registry()
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        listed = raw["entity_types"].items()
    except (OSError, ValueError, KeyError, AttributeError, TypeError) as e:
        log.warning("no registry in %s: %s", path, e)
        return Registry({}, ())
    types, relations = {}, []
    for name, held in listed:
        try:
            rule, norm = held.get("regex") or {}, held.get("normalise") or {}
            if rule:
                re.compile(rule["pattern"])
            types[name.upper()] = EntityType(name.upper(), norm.get("strategy", "trim"), tuple(a.upper() for a in held.get("llm_aliases", [])), held.get("color", "#888888"), rule.get("pattern"), int(rule.get("group", 0)), "i" in rule.get("flags", ""), {k: v for k, v in norm.items() if k != "strategy"})
        except (re.error, KeyError, AttributeError, TypeError, ValueError) as e:
            log.warning("type %s left out: %s", name, e)
    for held in raw.get("relation_patterns", []):
        try:
            made = re.compile(held["pattern"])
            if not {"source", "target"} <= set(made.groupindex):
                raise ValueError("no groups source and target")
            relations.append((held["relation_type"], held["pattern"]))
        except (re.error, KeyError, TypeError, ValueError) as e:
            log.warning("relation pattern left out: %s", e)
    return Registry(types, tuple(relations), tuple(raw.get("relation_hints", [])))
