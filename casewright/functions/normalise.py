"""Normal forms of entity names, one column expression for each strategy."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.registry import EXPANSIONS, SUFFIXES, TITLES, Registry, default_registry


def _titled(c: Column) -> Column:
    return F.trim(F.initcap(F.lower(F.regexp_replace(c, r"\s+", " "))))


def person(c: Column, titles: list[str] | None = None) -> Column:
    """Titles go, "Last, First" turns round if it has just two parts, words are capitalised."""
    t = c
    for title in TITLES if titles is None else titles:
        t = F.regexp_replace(t, rf"(?i)\b{re.escape(title)}\.?\b", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    parts = F.array_remove(F.transform(F.split(t, ","), lambda x: F.trim(x)), "")
    turned = F.when(t.contains(",") & (F.size(parts) == 2), F.concat_ws(" ", F.get(parts, 1), F.get(parts, 0))).otherwise(t)
    return _titled(turned)


def strip_suffix_title(c: Column, suffixes: list[str] | None = None) -> Column:
    t = F.trim(c)
    for suffix in SUFFIXES if suffixes is None else suffixes:
        t = F.regexp_replace(t, rf"(?i)\b{re.escape(suffix)}\b\.?", "")
    return _titled(F.trim(t))


def title_expand(c: Column, expansions: dict[str, str] | None = None) -> Column:
    """Abbreviations are expanded only in the case they are listed in."""
    t = F.trim(c)
    for pattern, word in (EXPANSIONS if expansions is None else expansions).items():
        t = F.regexp_replace(t, pattern, word)
    return _titled(t)


def phone_e164(c: Column) -> Column:
    d = F.regexp_replace(c, r"[^0-9]", "")
    d44 = F.when(d.startswith("00"), F.substring(d, 3, 1000)).when(d.startswith("0"), F.concat(F.lit("44"), F.substring(d, 2, 1000))).otherwise(d)
    return F.when(d == "", F.trim(c)).otherwise(F.concat(F.lit("+"), d44))


#: Registration formats; the first that fits puts a space between its two groups.
PLATES = [r"^([A-Z]{2}\d{2})([A-Z]{3})$", r"^([A-Z]\d{1,3})([A-Z]{3})$", r"^([A-Z]{3})(\d{1,3}[A-Z])$", r"^([A-Z]{1,3})(\d{1,4})$", r"^(\d{1,4})([A-Z]{1,3})$"]


def plate(c: Column) -> Column:
    t = F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    out = None
    for form in PLATES:
        spaced = F.regexp_replace(t, form, "$1 $2")
        out = F.when(t.rlike(form), spaced) if out is None else out.when(t.rlike(form), spaced)
    return out.otherwise(t)


def upper_snake(c: Column) -> Column:
    t = F.upper(F.regexp_replace(F.trim(c), r"[^\w\s-]", ""))
    return F.regexp_replace(F.regexp_replace(t, r"[\s-]+", "_"), "^_+|_+$", "")


def upper_compact(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(c), r"\s+", ""))


STRATEGIES = {
    "person": person,
    "strip_suffix_title": strip_suffix_title,
    "title_expand": title_expand,
    "phone_e164": phone_e164,
    "plate": plate,
    "upper_snake": upper_snake,
    "upper_compact": upper_compact,
    "lower": lambda c: F.lower(F.trim(c)),
    "trim": lambda c: F.trim(c),
}


def normalise(surface: Column, entity_type: Column, registry: Registry | None = None) -> Column:
    """The normal form by type; unknown types and strategies are trimmed, blank and null names give the empty text."""
    raw = F.trim(F.coalesce(surface, F.lit("")))
    out = F.when(raw == "", F.lit(""))
    for t in (registry or default_registry()).types.values():
        made = STRATEGIES.get(t.strategy, STRATEGIES["trim"])
        options = {"titles": t.options["strip_titles"]} if t.strategy == "person" and "strip_titles" in t.options else {}
        out = out.when(entity_type == t.name, made(raw, **options))
    return out.otherwise(raw)


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity, raised by a common prefix of up to four characters where it is above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    ours = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                ours.append(x)
                break
    if not ours:
        return 0.0
    theirs = [y for y, t in zip(b, taken, strict=True) if t]
    m = len(ours)
    moved = sum(x != y for x, y in zip(ours, theirs, strict=True)) // 2
    j = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * weight * (1 - j) if j > 0.7 else j


def jaro_winkler_column(a: Column, b: Column, weight: float = 0.1) -> Column:
    """The same of two columns in built-in functions, for names that are not empty."""
    letters = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(1)))
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def matched(x: Column, y: Column) -> Column:
        """What is left of y, with nulls for letters that x has met, and the letters of x that met one, in order."""
        reach = F.greatest(F.lit(0), F.floor(F.greatest(F.size(x), F.size(y)) / 2).cast("int") - 1)
        start = F.struct(y.alias("left"), F.filter(x, lambda _: F.lit(False)).alias("ours"))

        def meet(s: Column, i: Column) -> Column:
            low = F.greatest(F.lit(0), i - reach)
            c = F.get(x, i)
            at = F.coalesce(F.array_position(F.slice(s["left"], low + 1, F.greatest(F.lit(0), i + reach + 1 - low)), c).cast("int"), F.lit(0)) + low - 1
            hit = F.struct(F.transform(s["left"], lambda v, k: F.when(k != at, v)).alias("left"), F.concat(s["ours"], F.array(c)).alias("ours"))
            return F.when(at >= low, hit).otherwise(s)

        return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), start, meet)

    def score(x: Column, y: Column) -> Column:
        def of(s: Column) -> Column:
            theirs = F.filter(y, lambda _, k: F.get(s["left"], k).isNull())
            m = F.size(s["ours"])
            moved = F.floor(F.size(F.filter(F.zip_with(s["ours"], theirs, lambda p, q: p != q), lambda d: d)) / 2)
            j = (m / F.size(x) + m / F.size(y) + (m - moved) / m) / 3
            start = F.zip_with(F.slice(x, 1, 4), F.slice(y, 1, 4), lambda p, q: F.coalesce(p == q, F.lit(False)))
            first_off = F.array_position(start, F.lit(False)).cast("int")
            same = F.when(first_off == 0, F.size(start)).otherwise(first_off - 1)
            return F.when(m == 0, F.lit(0.0)).when(j > 0.7, j + same * F.lit(weight) * (1 - j)).otherwise(j)

        return let(matched(x, y), of)

    return F.when(a == b, F.lit(1.0)).otherwise(let(letters(a), lambda x: let(letters(b), lambda y: score(x, y))))
