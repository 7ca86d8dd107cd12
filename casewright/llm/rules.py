"""Quality rules as a short-circuit cascade.

Each rule is a built-in column expression that is true for a document to reject. A bounded sample gives every
rule's cost (seconds for its column over the sample, the median of several warm runs less those of a run without
rule) and selectivity (share of the sample it rejects); the rules are ordered by rejection per cost and chained in one
CASE over the text and its words, which are split once. A rule's measures are inside its branch, so they are computed
only for documents that the earlier rules let pass. The order never changes a verdict.

``judge`` has to report the base measures for every document, so only the method's own rules are short-circuited
there; ``filter_documents`` runs the whole cascade.

Null and empty texts have no words and fail the base rule. Very long texts are one row each; every step is at
most ``n log n`` in their words. Equal texts get equal verdicts. Extra columns pass through ``filter_documents``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm import textsql

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the measures' columns to a boolean column."""

    name: str
    rejects: object


def measures(t: Column, w: Column) -> dict[str, Column]:
    """Expressions of each measure over a text and its words; windows and lines are inside the measures that need them."""

    def repeated(tri: Column) -> Column:
        by_hash = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0)).otherwise(textsql.let(textsql.let(by_hash, places), covered))

    def places(s: Column) -> Column:
        near = lambda x, k: F.coalesce(x.h == F.get(s, k - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(s, k + 1).h, F.lit(False))
        return F.sort_array(F.transform(F.filter(s, near), lambda x: x.i))

    def covered(p: Column) -> Column:
        rest = F.greatest(F.size(p) - 1, F.lit(0))
        gaps = F.zip_with(F.slice(p, 2, rest), F.slice(p, 1, rest), lambda b, a: F.least(F.lit(3), b - a))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x))

    def counted(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"))

    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_upper": F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
        "lines": textsql.let(lines_of(t), counted),
        "n_repeat_words": textsql.let(textsql.windows(w, 3), repeated).cast("long"),
    }


def lines_of(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda x: x.rlike(textsql.LETTER))


#: The base: what makes ``base_failed``.
BASE = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
#: The method's own rules.
RULES = (
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 20 * m["n_words"]),
    Rule("word_length", lambda m: textsql.let(m["word_chars"], lambda c: (c < 2 * m["n_words"]) | (c > 20 * m["n_words"]))),
    Rule("duplicate_lines", lambda m: textsql.let(m["lines"], lambda c: 100 * c.getField("dup") > 50 * c.getField("n"))),
    Rule("upper_case", lambda m: 100 * m["n_upper"] > 50 * m["word_chars"]),
)


def sampled(docs: DataFrame, text: str, doc_id: str, rows: int) -> DataFrame:
    """About ``rows`` texts, those whose ids have certain hashes, from all partitions; four times as many at most."""
    one_of = max(1, docs.count() // max(1, rows))
    key = F.xxhash64(F.col(doc_id), F.lit("rules"))
    return docs.where(F.pmod(key, F.lit(one_of)) == 0).select(F.col(text).cast("string").alias("text")).limit(4 * rows)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, text: str = "text", doc_id: str = "doc_id", sample_rows: int = 500, runs: int = 3, copies: int = 4) -> list[Rule]:
    """``rules`` by rejection per cost, estimated on ``sampled``. An empty sample keeps the order.

    A run evaluates a rule for ``copies`` copies of the sample; the first run, which compiles it, does not count.
    """
    sample = sampled(docs, text, doc_id, sample_rows).cache()

    def timed(rejected: Column) -> tuple[float, int]:
        once = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
        found = once.select("copy", rejected.alias("hit")).agg(F.sum(F.when(F.col("hit") & (F.col("copy") == 1), 1).otherwise(0)))
        took, hits = [], 0
        for _ in range(runs + 1):
            began = time.perf_counter()
            hits = found.first()[0] or 0
            took.append(time.perf_counter() - began)
        return median(took[1:]), hits

    try:
        n = sample.count()
        if not n:
            return list(rules)
        idle, _ = timed(F.length("text") < 0)
        rated = []
        for k, rule in enumerate(rules):
            seconds, hits = timed(~verdict(F.col("text"), [rule]))
            rated.append((-(hits + 0.5) / n / max(seconds - idle, 1e-3), k, rule))
    finally:
        sample.unpersist()
    return [rule for _, _, rule in sorted(rated, key=lambda x: x[:2])]


def chained(m: dict[str, Column], ordered: list[Rule]) -> Column:
    """True where no rule rejects; a rule is evaluated only where those before it pass."""
    kept = F
    for rule in ordered:
        kept = kept.when(rule.rejects(m), F.lit(False))
    return kept.otherwise(F.lit(True)) if ordered else F.lit(True)


def verdict(text: Column, ordered: list[Rule]) -> Column:
    """The cascade straight from a text, whose words are split once."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return textsql.let(textsql.words(t), lambda w: chained(measures(t, w), ordered))


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ordered: list[Rule] | None = None) -> DataFrame:
    """doc_id, the base measures, ``base_failed`` and ``kept`` for every document."""
    if ordered is None:
        ordered = order_rules(docs, rules=RULES, text=text, doc_id=doc_id)
    own = [r for r in ordered if r not in BASE]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    frame = docs.select(F.col(doc_id).alias("doc_id"), t.alias("_t")).withColumn("_w", textsql.words(F.col("_t")))
    m = measures(F.col("_t"), F.col("_w"))
    base = ["n_words", "word_chars", "n_symbols", "lines", "n_repeat_words"]
    out = frame.select("doc_id", "_t", *[m[k].alias(k) for k in base])
    held = {k: F.col(k) for k in base} | {"n_upper": m["n_upper"]}
    failed = BASE[0].rejects(held) | BASE[1].rejects(held)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(chained(held, own))
    return out.withColumn("base_failed", failed).withColumn("kept", kept).withColumn("n_dup_lines", F.col("lines.dup")).drop("_t", "lines")


def filter_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ordered: list[Rule] | None = None) -> DataFrame:
    """The documents that pass, with all their columns; measures are computed only as far as the cascade needs them."""
    ordered = order_rules(docs, text=text, doc_id=doc_id) if ordered is None else ordered
    return docs.where(verdict(docs[text], ordered))
