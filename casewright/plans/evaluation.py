"""Evaluation fixtures and their figures."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators import claims

CASES = "name string, query string, case_ref string, expected_doc_ids array<string>, expected_supported_claims array<string>, recall_mode string"


def load_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON fixture: a list, or an object with ``cases``."""
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    cases = raw if isinstance(raw, list) else raw.get("cases", [])
    names = [c.split()[0] for c in CASES.split(", ")]
    return spark.createDataFrame([tuple(c.get(n) for n in names) for c in cases], CASES)


def retrieval_recall(cases: DataFrame, got: DataFrame) -> DataFrame:
    """``name, recall``; got: ``query_id, doc_id`` with the case's name as query_id. Nothing expected counts as 1."""
    wanted = cases.select(F.col("name").alias("query_id"), F.explode_outer("expected_doc_ids").alias("doc_id"))
    none = wanted.where("doc_id is null").select("query_id", F.lit(1.0).alias("recall"))
    return claims.recall(wanted.where("doc_id is not null"), got).unionByName(none)


def grounded_recall(cases: DataFrame, supported: DataFrame) -> DataFrame:
    """``name, recall``: the share of expected claims that stand in a supported one; supported: ``query_id, text``."""
    said = supported.groupBy("query_id").agg(F.lower(F.array_join(F.collect_list("text"), "\n")).alias("said"))
    c = cases.join(said, cases["name"] == said["query_id"], "left")
    hit = F.size(F.filter("expected_supported_claims", lambda x: F.contains(F.coalesce("said", F.lit("")), F.lower(x))))
    n = F.size("expected_supported_claims")
    return c.select("name", F.round(F.when(n > 0, hit / n).otherwise(1.0), 4).alias("recall"))


def averages(*parts: DataFrame) -> list[float]:
    return [float(p.agg(F.round(F.avg("recall"), 4)).first()[0] or 0.0) for p in parts]
