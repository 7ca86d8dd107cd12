"""The hybrid query: retrieve four ways, fuse, cover documents, build the evidence packet, answer, validate."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import claims, edges, retrieve, tools, walk
from casewright.plans import answers, intents
from casewright.projection import Graph


@dataclass
class Store:
    """The tables a query reads. mentions: ``alias_id, entity_id, alias_text, doc_id, chunk_id``; vectors may be absent."""

    graph: Graph
    chunks: DataFrame
    mentions: DataFrame
    vectors: DataFrame | None = None


@dataclass
class Result:
    intent: str
    scope: str
    ranked: DataFrame
    packet: dict[str, DataFrame] = field(default_factory=dict)
    answer: str = ""
    claims: list[dict] = field(default_factory=list)
    cache_hit: bool = False


class QueryCache:
    """The last results, by question, scope, mode and a hash of the corpus."""

    def __init__(self, most: int = 128):
        self.most, self.held = most, OrderedDict()

    def key(self, *parts) -> str:
        return hashlib.sha256("\x1f".join(str(p).strip().lower() for p in parts).encode()).hexdigest()

    def get(self, key: str):
        if key in self.held:
            self.held.move_to_end(key)
        return self.held.get(key)

    def put(self, key: str, value) -> None:
        self.held[key] = value
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)


def candidates(spark, question: str, parsed: dict, store: Store, scope: tools.Scope, times: int, query_vector: list[float] | None = None) -> DataFrame:
    """All four sources' candidates with one schema, restricted to the scope before any top-k."""
    docs = store.graph.documents
    chunks = scope.rows(store.chunks, docs)
    empty = F.lit(None).cast("string")
    shape = lambda df, source: df.select(F.lit("q").alias("query_id"), F.lit(source).alias("source"), *[(F.col(c) if c in df.columns else empty).alias(c) for c in ("chunk_id", "rel_id", "entity_id", "doc_id", "text")], F.col("page").cast("int").alias("page"), F.col("score").cast("double").alias("score"), F.row_number().over(_order).alias("ordinal"))
    from pyspark.sql.window import Window

    _order = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "doc_id", "page", "tie")
    parts = []
    if tokens := list(dict.fromkeys(retrieve.exact_tokens(question) + parsed["exact_tokens"] + parsed["entities"])):
        hit = retrieve.exact_lookup(scope.rows(store.mentions, docs), store.graph.entities, tokens, max(20, 20 * times))
        parts.append(shape(hit.withColumn("tie", F.col("alias_id")).withColumn("page", F.lit(None).cast("int")), "exact"))
    asked = spark.createDataFrame([("q", question)], "query_id string, text string")
    fts = retrieve.bm25(chunks.select(F.col("chunk_id").alias("doc_id"), "text"), asked, 15 * times).select(F.col("doc_id").alias("chunk_id"), "score")
    parts.append(shape(fts.join(chunks, "chunk_id").withColumn("tie", F.col("chunk_id")), "fts"))
    if store.vectors is not None and query_vector is not None:
        v = spark.createDataFrame([("q", [float(x) for x in query_vector])], "query_id string, query array<float>")
        near = retrieve.vector_top(scope.rows(store.vectors, docs).select(F.col("chunk_id").alias("vec_id"), F.col("vector").alias("embedding")), v, 10 * times)
        parts.append(shape(near.select(F.col("vec_id").alias("chunk_id"), F.col("similarity").alias("score")).join(chunks, "chunk_id").withColumn("tie", F.col("chunk_id")), "vector"))
    if parsed["entities"]:
        low = [e.lower() for e in parsed["entities"]]
        seeds = [r[0] for r in store.graph.entities.where(F.lower("canonical_name").isin(low)).select("entity_id").orderBy("entity_id").limit(50).collect()]
        if seeds:
            limit = max(50, 40 * times)
            two = walk.two_stage(store.graph.relationships, seeds, limit)
            ev = scope.rows(store.graph.evidence, docs).select("rel_id", "doc_id", "page", F.col("span_text").alias("text"), "evidence_id")
            parts.append(shape(two.join(ev, "rel_id").withColumn("score", F.col("confidence")).withColumn("tie", F.col("evidence_id")), "graph"))
    if parsed["document_refs"]:
        names = [n.lower() for n in parsed["document_refs"]]
        named = chunks.join(docs.where(F.lower("filename").isin(names)).select("doc_id"), "doc_id", "left_semi")
        parts.append(shape(named.withColumn("score", F.lit(0.95)).withColumn("tie", F.col("chunk_id")).orderBy("page", "chunk_id").limit(12 * times), "document"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    key = retrieve.result_key(F.col("source"), F.col("rel_id"), F.col("entity_id"), F.col("doc_id"), F.col("chunk_id"), F.col("ordinal"))
    return out.withColumn("key", key)


def packet(ranked: DataFrame, store: Store, scope: tools.Scope) -> dict[str, DataFrame]:
    """The bounded evidence that an answer may use."""
    order = retrieve.ranked_order()
    of = lambda *sources: ranked.where(F.col("source").isin(list(sources))).orderBy(*order)
    rels = edges.edge_view(store.graph).select("rel_id", "source_name", "target_name", "relation_type", "confidence", "evidence_count")
    graph = of("graph").limit(50).join(rels, "rel_id")
    return {
        "exact_matches": of("exact").limit(30),
        "chunks": of("fts", "vector", "document").limit(20),
        "graph_evidence": graph,
        "relationships": graph.groupBy("source_name", "target_name", "relation_type").agg(F.max("confidence").alias("confidence"), F.count_distinct("doc_id").alias("doc_count"), F.count(F.lit(1)).alias("evidence_count")),
        "negative_evidence": claims.negative_evidence(ranked.select("doc_id", "page", "text")),
    }


def run_query(spark, question: str, store: Store, case_ref: str | None = None, doc_ids: tuple[str, ...] = (), mode: str = "auto", top_n: int = 20, history: list[tuple[str, str]] | None = None, query_vector: list[float] | None = None, answer: Callable[[str, dict], str] | None = None, strict: bool = True, cache: QueryCache | None = None, corpus: str = "") -> Result:
    """One question end to end; ``answer`` is the hook for a model, the built-in answers are deterministic.

    With a ``cache`` the same question under the same settings is answered from it, as long as ``corpus`` (a hash of the rows,
    as ``tools.corpus_hash`` gives) is the same. Question and settings differ by more than case and space at the ends.
    """
    asked = intents.with_history(question, history or [])
    name = None
    if cache is not None:
        name = cache.key(" ".join(asked.split()), case_ref or "", ",".join(sorted(doc_ids)), mode, top_n, strict, query_vector, getattr(answer, "__qualname__", ""), corpus)
        if (held := cache.get(name)) is not None:
            return replace(held, cache_hit=True, claims=[dict(c) for c in held.claims])
    parsed = intents.parse(asked)
    scope = tools.Scope("document", doc_ids=doc_ids) if doc_ids else tools.Scope("case", case_ref=case_ref) if case_ref else tools.Scope()
    _, times, least = retrieve.recall_mode(mode, parsed["recall_priority"])
    ranked = retrieve.fuse(candidates(spark, asked, parsed, store, scope, times, query_vector))
    bounded = ranked.orderBy(*retrieve.ranked_order()).limit(top_n * max(2, times))
    chosen = retrieve.cover_documents(bounded, top_n, least).select("query_id", "key")
    top = bounded.join(chosen, ["query_id", "key"], "left_semi")
    made = packet(top, store, scope)
    rows = {k: [r.asDict(recursive=True) for r in v.collect()] for k, v in made.items()}
    said = answer(asked, rows) if answer else answers.deterministic(parsed, rows)
    checked = answers.validate(answers.claims_of(said, rows), rows)
    got = Result(parsed["intent"], scope.describe(), top, made, answers.render(said, checked, strict), checked)
    if cache is not None:
        cache.put(name, got)
    return got
