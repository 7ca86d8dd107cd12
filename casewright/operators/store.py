"""Changes to stored tables as DataFrames: upserts, cascades, review, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the last by ``order``; rows with a null key all pass."""
    null = None
    for k in keys:
        null = F.col(k).isNull() if null is None else null | F.col(k).isNull()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order]))
    return rows.withColumn("_r", rank).where((F.col("_r") == 1) | null).drop("_r")


def upsert(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``held`` without the keys of ``new``, and ``new``; columns that one side lacks are null."""
    return held.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def create_cases(held: DataFrame, new: DataFrame) -> DataFrame:
    """New cases whose reference is not there yet in any case of letters."""
    known = held.select(F.lower("case_ref").alias("_k"))
    fresh = new.withColumn("_k", F.lower("case_ref")).join(known, "_k", "left_anti")
    return held.unionByName(last_wins(fresh, ["_k"], [F.asc("case_id")]).drop("_k"))


def review(items: DataFrame, asked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(items that were asked for, asked keys that are not there)."""
    keys = asked.select(key).distinct()
    return items.join(keys, key, "left_semi"), keys.join(items, key, "left_anti")


def confirmed(entities: DataFrame, reviews: DataFrame) -> DataFrame:
    """Entities with confidence 1 where they were confirmed; reviews: ``entity_id, reviewed_at, reviewed_by``."""
    last = reviews.groupBy("entity_id").agg(F.max_by(F.struct("reviewed_at", "reviewed_by"), "reviewed_at").alias("_v"))
    out = entities.drop("reviewed_at", "reviewed_by").join(last, "entity_id", "left")
    return out.withColumn("confidence", F.when(F.col("_v").isNotNull(), F.lit(1.0)).otherwise(F.col("confidence"))).withColumn("reviewed_at", F.col("_v.reviewed_at")).withColumn("reviewed_by", F.col("_v.reviewed_by")).drop("_v")


def delete_entities(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the entities of ``gone`` and all that hangs on them, and the rows that went by table."""
    ids = gone.select("entity_id").distinct()
    rels = tables["relationships"]
    dead = rels.join(ids.withColumnRenamed("entity_id", "source_entity"), "source_entity", "left_semi").select("rel_id").unionByName(rels.join(ids.withColumnRenamed("entity_id", "target_entity"), "target_entity", "left_semi").select("rel_id")).distinct()
    left = {
        "entities": tables["entities"].join(ids, "entity_id", "left_anti"),
        "entity_aliases": tables["entity_aliases"].join(ids, "entity_id", "left_anti"),
        "relationships": rels.join(dead, "rel_id", "left_anti"),
        "relationship_evidence": tables["relationship_evidence"].join(dead, "rel_id", "left_anti"),
    }
    counts = None
    for name, now in left.items():
        n = tables[name].agg(F.count(F.lit(1)).alias("before")).crossJoin(now.agg(F.count(F.lit(1)).alias("after"))).select(F.lit(name).alias("table"), (F.col("before") - F.col("after")).alias("deleted"))
        counts = n if counts is None else counts.unionByName(n)
    return left, counts


def mention_counts(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """mention_count is one more than an entity's alias rows; confidence the highest of entity and mentions."""
    n = aliases.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_n"), F.max("resolution_confidence").alias("_c"))
    out = entities.drop("mention_count").join(n, "entity_id", "left").withColumn("mention_count", 1 + F.coalesce("_n", F.lit(0)))
    return out.withColumn("confidence", F.greatest("confidence", "_c")).drop("_n", "_c")


def latest(rows: DataFrame, by: list, order: list[Column]) -> DataFrame:
    """The first row of each group by ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def changed_sources(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files that are new or have another hash than the latest document of their path and case, with what they supersede.

    files: ``filepath, case_id, source_hash``; an old document without a hash counts as unchanged.
    """
    last = latest(documents, ["filepath", "case_id"], [F.desc_nulls_last("ingested_at"), F.desc("doc_id")]).select("filepath", "case_id", F.col("doc_id").alias("supersedes_doc_id"), F.col("source_hash").alias("_h"))
    out = files.join(last, ["filepath", "case_id"], "left")
    same = F.col("supersedes_doc_id").isNotNull() & (F.col("_h").isNull() | (F.col("_h") == F.col("source_hash")))
    return out.where(~same).drop("_h")


def vector_upsert(held: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """Vectors by chunk_id, the last of ``new`` wins; rows without chunk_id are added."""
    return upsert(held, last_wins(new, ["chunk_id"], [order.desc()]).drop("_seq"), ["chunk_id"])
