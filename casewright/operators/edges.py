"""Edge views over relationships, entities and evidence."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.projection import Graph
from casewright.session import written


@dataclass(frozen=True)
class EdgeFilter:
    case_ref: str | None = None
    min_confidence: float | None = None
    include_types: tuple[str, ...] = ()
    exclude_types: tuple[str, ...] = ()

    def apply(self, graph: Graph) -> DataFrame:
        """The relationships that pass; a case is a semi-join on the documents that evidence them."""
        rels = graph.relationships
        if self.min_confidence is not None:
            rels = rels.where(F.col("confidence") >= min(1.0, max(0.0, self.min_confidence)))
        if self.include_types:
            rels = rels.where(F.upper("relation_type").isin([t.upper() for t in self.include_types]))
        if self.exclude_types:
            rels = rels.where(~F.upper("relation_type").isin([t.upper() for t in self.exclude_types]))
        if self.case_ref is not None:
            docs = graph.documents.where(F.lower("case_ref") == self.case_ref.lower()).select("doc_id")
            rels = rels.join(graph.evidence.join(docs, "doc_id", "left_semi").select("rel_id"), "rel_id", "left_semi")
        return rels


def weight(confidence: Column, evidence_count: Column) -> Column:
    """The cost of an edge: weak and rarely evidenced edges cost more."""
    return F.lit(1.0) / (F.greatest(confidence, F.lit(0.05)) * (F.lit(1.0) + F.lit(0.25) * F.log1p(evidence_count)))


def edge_view(graph: Graph, flt: EdgeFilter = EdgeFilter()) -> DataFrame:
    """Relationships with both entities, evidence_count, distinct_doc_count and weight; those without evidence count 0."""
    end = lambda side: graph.entities.select(F.col("entity_id").alias(f"{side}_entity"), F.col("canonical_name").alias(f"{side}_name"), F.col("entity_type").alias(f"{side}_type"))
    if graph.counted is not None:
        out = flt.apply(replace(graph, relationships=graph.counted))
    else:
        counts = graph.evidence.groupBy("rel_id").agg(F.count(F.lit(1)).alias("evidence_count"), F.count_distinct("doc_id").alias("distinct_doc_count"))
        out = flt.apply(graph).join(counts, "rel_id", "left").fillna(0, ["evidence_count", "distinct_doc_count"])
    out = out.join(end("source"), "source_entity").join(end("target"), "target_entity")
    return out.withColumn("weight", F.round(weight(F.col("confidence"), F.col("evidence_count")), 6))


def top_citations(graph: Graph, most: int = 3) -> DataFrame:
    """Up to ``most`` evidence rows of each relationship, by page, nulls last, then id."""
    rank = F.row_number().over(Window.partitionBy("rel_id").orderBy(F.asc_nulls_last("page"), "evidence_id"))
    return graph.evidence.withColumn("rank", rank).where(F.col("rank") <= most)


def adjacency(rels: DataFrame) -> DataFrame:
    """Every edge from both of its ends, so that neighbours are an equi-join: ``node, neighbour, ...``."""
    keep = [c for c in rels.columns if c not in ("source_entity", "target_entity")]
    out = rels.select(F.col("source_entity").alias("node"), F.col("target_entity").alias("neighbour"), *keep)
    back = rels.where("source_entity != target_entity").select(F.col("target_entity").alias("node"), F.col("source_entity").alias("neighbour"), *keep)
    return out.unionByName(back)


def other_end(entity: Column) -> Column:
    return F.when(F.col("source_entity") == entity, F.col("target_entity")).otherwise(F.col("source_entity"))


def collapse_parallel(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair and type: summed evidence, highest confidence; loops go."""
    a, b = F.least("source_entity", "target_entity"), F.greatest("source_entity", "target_entity")
    return edges.where("source_entity != target_entity").groupBy(a.alias("a"), b.alias("b"), "relation_type").agg(F.sum("evidence_count").alias("evidence_count"), F.max("confidence").alias("confidence"))


def best_edge_per_pair(edges: DataFrame) -> DataFrame:
    """The cheapest edge of each unordered pair; ties by rel_id."""
    a, b = F.least("source_entity", "target_entity"), F.greatest("source_entity", "target_entity")
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("weight", "rel_id"))
    return edges.where("source_entity != target_entity").withColumns({"a": a, "b": b}).withColumn("rank", rank).where("rank = 1").drop("rank")


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, name`` of all nodes, numbers in the order of the names, and the edges with numbers for their ends.

    Loops over many edges carry numbers: shorter than names, and ties by them fall as by names.
    """
    held = written(edges.where("source_entity is not null and target_entity is not null"))
    nodes = held.select(F.explode(F.array("source_entity", "target_entity")).alias("name")).distinct()
    ids = written(nodes.orderBy("name").select(F.monotonically_increasing_id().alias("id"), "name"))
    end = lambda side: ids.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_entity"))
    out = held.join(end("source"), "source_entity").join(end("target"), "target_entity").drop("source_entity", "target_entity")
    return ids, out.withColumnsRenamed({"source_id": "source_entity", "target_id": "target_entity"})
