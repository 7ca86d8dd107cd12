"""Grounding: denials, support of claims by evidence, recall of an evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import text
from casewright.session import written


def negative_evidence(rows: DataFrame, most: int | None = 20, pattern: str = text.DENIAL) -> DataFrame:
    """Rows whose text denies something, one for each document, page and text, by document and page."""
    found = rows.where(F.col("text").rlike(pattern)).dropDuplicates(["doc_id", "page", "text"]).withColumn("kind", F.lit("explicit_denial"))
    return found.orderBy("doc_id", "page", "text").limit(most) if most is not None else found


def support(claim: Column, spans: Column) -> Column:
    """(status, confidence) by the share of the claim's longer words that stand in the joined spans."""
    joined = F.lower(F.array_join(spans, " "))
    words = F.filter(F.split(F.lower(F.trim(claim)), r"\s+"), lambda w: F.length(w) > 3)
    ratio = F.size(F.filter(words, lambda w: F.contains(joined, w))) / F.size(words)
    status = lambda s, c: F.struct(F.lit(s).alias("status"), F.lit(c).alias("confidence"))
    return F.when((F.size(words) == 0) | (F.size(spans) == 0) | (ratio < 0.4), status("UNSUPPORTED", 0.2)).when(ratio >= 0.8, status("SUPPORTED", 0.75)).otherwise(status("PARTIALLY_SUPPORTED", 0.55))


def validate(claims: DataFrame) -> DataFrame:
    """Claims (``claim, spans``) with status and confidence; one without citations is unsupported at 0.1."""
    none = F.struct(F.lit("UNSUPPORTED").alias("status"), F.lit(0.1).alias("confidence"))
    out = claims.withColumn("_s", F.when(F.coalesce(F.size("spans"), F.lit(0)) == 0, none).otherwise(support(F.col("claim"), F.col("spans"))))
    return out.withColumn("status", F.col("_s.status")).withColumn("confidence", F.col("_s.confidence")).drop("_s")


def _sharing(asked: DataFrame, held: DataFrame, claim: str, other: str, least: float, most_sent: int = 500_000) -> DataFrame:
    """Rows of both tables side by side, where the text ``other`` has at least ``least`` of the words of the text ``claim``.

    An inverted index in place of all pairs: of n words at least ceil(least * n) have to be in the other text, so one of any
    n - ceil(least * n) + 1 is; a claim looks up its rarest ones, and only what meets is counted in full. Rows meet at the first
    of these that the other text has, so a pair meets once. The words looked up are sent to the other texts where they are at most
    ``most_sent``; the texts themselves stay where they are.
    """
    if least <= 0:
        raise ValueError("an overlap of 0 is every pair")
    sent = lambda df: F.broadcast(df) if df.count() <= most_sent else df
    asked = written(asked.withColumn("_asked", text.word_set(F.col(claim))).where(F.size("_asked") > 0))
    sets = asked.select("_asked").distinct()
    held = held.where(F.col(other).isNotNull()).withColumn("_held", text.word_set(F.col(other)))
    vocabulary = written(sets.select(F.explode("_asked").alias("_word")).distinct())
    often = held.select(F.explode("_held").alias("_word")).join(sent(vocabulary), "_word", "left_semi").groupBy("_word").agg(F.count(F.lit(1)).alias("often"))
    ranked = sets.select("_asked", F.explode("_asked").alias("_word")).join(often, "_word", "left")
    ranked = ranked.groupBy("_asked").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "_word"))).alias("ranked"))
    first = F.slice("ranked", F.lit(1), F.size("ranked") - F.ceil(F.lit(least) * F.size("ranked") - F.lit(1e-9)).cast("int") + 1)
    looked = asked.join(ranked.select("_asked", first["_word"].alias("_first")), "_asked")
    looked = written(looked.select("*", F.explode("_first").alias("_word")))
    met = held.select("*", F.explode("_held").alias("_word")).join(sent(looked), "_word")
    enough = F.size(F.array_intersect("_asked", "_held")) / F.size("_asked") >= least
    once = F.get(F.array_intersect("_first", "_held"), F.lit(0)) == F.col("_word")
    return met.where(enough & once).drop("_word", "_asked", "_first", "_held")


def overlapping(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``left, right``: distinct texts of two one-column tables of which the right has at least ``least`` of the left's words."""
    each = lambda df, name: df.select(F.col(df.columns[0]).alias(name)).distinct()
    return _sharing(each(left, "left"), each(right, "right"), "left", "right", least).select("left", "right")


def denied(claims: DataFrame, negatives: DataFrame, least: float = 0.45, carry: tuple[str, ...] = ()) -> DataFrame:
    """Denial claims with the negative rows that share enough of their words, as ``denial`` with the columns ``carry``."""
    asked = claims.where(F.col("claim").rlike(text.DENIAL_CLAIM))
    return _sharing(asked, negatives.select(F.col("text").alias("denial"), *carry), "claim", "denial", least).select(*claims.columns, "denial", *carry)


def recall(expected: DataFrame, got: DataFrame) -> DataFrame:
    """``query_id, recall``: the share of each query's expected documents that were retrieved."""
    hit = expected.join(got.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), 4).alias("recall"))
