"""Scoped look-ups over the evidence model: what an analyst's tools ask."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.session import written

MOST = 25


class ScopeViolation(Exception):
    """Something outside the scope was asked for."""


@dataclass(frozen=True)
class Scope:
    """``mode``: document, case or corpus."""

    mode: str = "corpus"
    doc_ids: tuple[str, ...] = ()
    case_ref: str | None = None

    def __post_init__(self):
        if self.mode not in ("document", "case", "corpus"):
            raise ScopeViolation(f"unknown scope {self.mode}")
        if self.mode == "document" and not self.doc_ids:
            raise ScopeViolation("a document scope needs documents")
        if self.mode == "case" and not self.case_ref:
            raise ScopeViolation("a case scope needs a case")

    def documents(self, documents: DataFrame) -> DataFrame:
        if self.mode == "document":
            return documents.where(F.col("doc_id").isin(list(self.doc_ids)))
        return documents.where(F.col("case_ref") == self.case_ref) if self.mode == "case" else documents

    def rows(self, rows: DataFrame, documents: DataFrame, doc: str = "doc_id") -> DataFrame:
        """``rows`` of documents in scope; rows that carry the ``case_ref`` of their document are not joined with it."""
        if self.mode == "corpus":
            return rows
        if self.mode == "case" and "case_ref" in rows.columns:
            return rows.where(F.col("case_ref") == self.case_ref)
        if self.mode == "document":
            return rows.where(F.col(doc).isin(list(self.doc_ids)))
        return rows.join(self.documents(documents).select(F.col("doc_id").alias(doc)), doc, "left_semi")

    def check(self, documents: DataFrame, doc_id: str) -> None:
        if not self.documents(documents).where(F.col("doc_id") == doc_id).limit(1).count():
            raise ScopeViolation(f"{doc_id} is outside the scope")

    def describe(self) -> str:
        return {"document": f"{len(self.doc_ids)} document(s)", "case": f"case {self.case_ref}", "corpus": "all documents"}[self.mode]


def _sent(rows: DataFrame, most_sent: int = 500_000) -> DataFrame:
    """Rows to be broadcast where they are at most ``most_sent``."""
    return F.broadcast(rows) if rows.count() <= most_sent else rows


def search_entities(mentions: DataFrame, entities: DataFrame, query: str, entity_type: str | None = None, limit: int = MOST) -> DataFrame:
    """Entities whose name or alias has ``query`` in it in any case; counts are over the mentions that passed.

    mentions: ``entity_id, alias_text, doc_id``. Ordered by mentions, documents, id.
    """
    named = entities if entity_type is None else entities.where(F.col("entity_type") == entity_type)
    low = query.lower()
    # a name or an alias: two joins of few rows each, not one of all mentions that is looked through after it
    in_name, in_alias = F.coalesce(F.contains(F.lower("canonical_name"), F.lit(low)), F.lit(False)), F.contains(F.lower("alias_text"), F.lit(low))
    by_name = mentions.join(_sent(named.where(in_name)), "entity_id")
    hit = by_name.unionByName(named.where(~in_name).join(mentions.where(in_alias), "entity_id").select(by_name.columns))
    out = hit.groupBy("entity_id", "canonical_name", "entity_type").agg(F.count(F.lit(1)).alias("mention_count"), F.count_distinct("doc_id").alias("doc_count"), F.slice(F.array_sort(F.collect_set("alias_text")), 1, 5).alias("aliases"))
    return out.orderBy(F.desc("mention_count"), F.desc("doc_count"), "entity_id").limit(max(1, min(limit, MOST)))


def _counts(mentions: DataFrame, **more: Column) -> DataFrame:
    """``entity_id, mention_count, doc_count`` and ``more``, which has to be its own aggregate (min, max).

    Mentions with ``doc_key`` are counted by document first, where they lie already; each then stands in that document alone.
    """
    extra = [c.alias(name) for name, c in more.items()]
    if "doc_key" not in mentions.columns:
        return mentions.groupBy("entity_id").agg(F.count_distinct("mention_id").alias("mention_count"), F.count_distinct("doc_id").alias("doc_count"), *extra)
    per = mentions.groupBy("entity_id", "doc_key").agg(F.count_distinct("mention_id").alias("mention_count"), *extra)
    again = [c.alias(name) for name, c in more.items()]
    return per.groupBy("entity_id").agg(F.sum("mention_count").alias("mention_count"), F.count("doc_key").alias("doc_count"), *again)


def entity_profile(entities: DataFrame, mentions: DataFrame, in_scope: DataFrame | None = None) -> DataFrame:
    """Each entity with the number of its mentions and documents in scope; entities without any count 0.

    in_scope: the documents, None where the mentions are in scope already.
    """
    m = mentions if in_scope is None else mentions.join(in_scope.select("doc_id").distinct(), "doc_id", "left_semi")
    n = _counts(m.select("*", F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen")), first_seen=F.min("first_seen"), last_seen=F.max("last_seen"))
    return entities.join(n, "entity_id", "left").fillna(0, ["mention_count", "doc_count"])


def resolve_ids(entities: DataFrame, mentions: DataFrame, names: list[str]) -> DataFrame:
    """``position, entity_id``: everything that the names stand for among the mentions in scope, in order, each entity once.

    A name is an id, or a canonical name or alias in any case; one that is none of these stands for all entities whose name
    or alias has it in it. Within a name by mentions, documents, id. names: the few that a user asks for.
    entities: ``entity_id, canonical_name, mention_count``; mentions: ``entity_id, alias_text, doc_id``, in scope already.
    """
    asked = [(k, n.strip()) for k, n in enumerate(names) if n and n.strip()]
    spark = entities.sparkSession
    few = F.broadcast(spark.createDataFrame(asked, "position int, asked string"))
    known = mentions.groupBy("entity_id", "alias_text").agg(F.collect_set("doc_id").alias("docs")).join(entities.select("entity_id", "canonical_name", "mention_count"), "entity_id")
    low = F.lower("asked")
    said = known.join(few, F.lower("canonical_name").contains(low) | F.lower("alias_text").contains(low) | (F.col("entity_id") == F.col("asked")))
    exact = (F.col("entity_id") == F.col("asked")) | (F.lower("canonical_name") == low) | (F.lower("alias_text") == low)
    per = said.groupBy("position", "entity_id", exact.alias("exact")).agg(F.first("mention_count").alias("mention_count"), F.size(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("doc_count"))
    sure = F.max("exact").over(Window.partitionBy("position"))
    per = per.withColumn("sure", sure).where("exact = sure")
    first = F.row_number().over(Window.partitionBy("entity_id").orderBy("position"))
    per = per.withColumn("first", first).where("first = 1")
    return per.orderBy("position", F.coalesce("mention_count", F.lit(0)).desc(), F.desc("doc_count"), "entity_id").select("position", "entity_id")


def profile_in_scope(entities: DataFrame, mentions: DataFrame, documents: DataFrame, scope: Scope, most: int = 5, most_aliases: int = 10) -> DataFrame:
    """Profiles of all entities that the scope mentions; one without a mention there has none.

    ``entity_id, canonical_name, entity_type, mention_count, doc_count, first_seen_doc, first_seen_page, last_seen_doc,
    last_seen_page, top_aliases, citations``. Citations are by page, nulls last and then 0, at most ``most``; first and last
    seen are the first and last of them. mentions: ``entity_id, mention_id, alias_text, doc_id, page, chunk_id``, and where the
    source has them ``doc_key, case_ref, filename`` of the document, which is then not joined.
    """
    m = scope.rows(mentions, documents)
    n = _counts(m)
    once = m.select("entity_id", "alias_text").distinct()
    by_name = F.row_number().over(Window.partitionBy("entity_id").orderBy("alias_text"))
    aliases = once.where("alias_text is not null").withColumn("r", by_name).where(F.col("r") <= most_aliases).groupBy("entity_id").agg(F.array_sort(F.collect_list("alias_text")).alias("top_aliases"))
    # the first rows of an entity are kept before the shuffle, so an entity of very many mentions is no large group
    by_page = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.asc_nulls_last("page"), "doc_id", "mention_id"))
    known = m if "filename" in m.columns else m.join(documents.select("doc_id"), "doc_id", "left_semi")
    cited = known.withColumn("r", by_page).where(F.col("r") <= most)
    cited = cited if "filename" in m.columns else cited.join(documents.select("doc_id", "filename"), "doc_id")
    row = F.struct("r", "doc_id", F.col("filename").alias("doc_name"), F.coalesce(F.col("page").cast("int"), F.lit(0)).alias("page"), "chunk_id")
    citations = cited.groupBy("entity_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    out = entities.select("entity_id", "canonical_name", "entity_type").join(n, "entity_id").join(aliases, "entity_id", "left").join(citations, "entity_id", "left")
    of = lambda at, c: F.try_element_at("c", F.lit(at))[c]
    return out.select(
        "entity_id", "canonical_name", "entity_type", "mention_count", "doc_count", of(1, "doc_name").alias("first_seen_doc"), of(1, "page").alias("first_seen_page"), of(-1, "doc_name").alias("last_seen_doc"), of(-1, "page").alias("last_seen_page"),
        F.coalesce("top_aliases", F.array().cast("array<string>")).alias("top_aliases"), F.transform("c", lambda x: x.dropFields("r")).alias("citations"),
    )


def cooccurrence(mentions: DataFrame, a: str, b: str, unit: str = "doc_id") -> DataFrame:
    """The units where both entities are mentioned."""
    of = lambda e: mentions.where(F.col("entity_id") == e).select(unit).distinct()
    return of(a).join(of(b), unit, "left_semi")


def cooccurrence_counts(mentions: DataFrame, unit: str, item: str, most: int) -> DataFrame:
    """``a, b, n``: in how many units two items occur together; the ``most`` frequent pairs."""
    one = mentions.select(unit, item).distinct()
    pairs = one.select(unit, F.col(item).alias("a")).join(one.select(unit, F.col(item).alias("b")), unit).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "a", "b").limit(most)


def timeline(evidence: DataFrame, relationships: DataFrame, entity_ids: list[str] | None = None) -> DataFrame:
    """Evidence with an event time, in order; of the given entities' relationships only."""
    rels = relationships
    if entity_ids is not None:
        rels = rels.where(F.col("source_entity").isin(entity_ids) | F.col("target_entity").isin(entity_ids))
    return evidence.where(F.col("event_time").isNotNull()).join(rels.select("rel_id", "source_entity", "target_entity", "relation_type"), "rel_id").orderBy("event_time", "evidence_id")


def documents_with_counts(documents: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Documents with the numbers of their chunks and distinct entities, newest first."""
    c = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    e = mentions.groupBy("doc_id").agg(F.count_distinct("entity_id").alias("entity_count"))
    return documents.join(c, "doc_id", "left").join(e, "doc_id", "left").fillna(0, ["chunk_count", "entity_count"])


def page_text(chunks: DataFrame, by: list[str], order: Column, text: str = "text", between: str = "\n\n") -> DataFrame:
    """Chunks of a page joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("k"), F.col(text).alias("t"))))
    return chunks.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x.t), between).alias("text"))


def hash_tree(rows: DataFrame, columns: list[str], depth: int | None = None, leaf: int = 4096) -> DataFrame:
    """``prefix, level, hash, n``: hashes of rows joined by hash prefix, leaves at ``depth`` hexadecimal digits up to the root.

    A leaf is the hash of its rows' hashes in order, each with how often it is there; a node above is the hash of its at
    most 16 children in order. The depth follows the number of rows, so that a leaf holds about ``leaf`` hashes however
    many rows there are, equal ones included; a changed row changes one branch.
    """
    one = rows.select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256).alias("h"))
    each = one.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    if depth is None:
        distinct, depth = each.count(), 0
        while distinct > leaf * 16**depth:
            depth += 1
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "h", F.col("n").cast("string"))))
    level = each.groupBy(F.substring("h", 1, depth).alias("prefix")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("hash"), F.sum("n").alias("n"))
    level = written(level)
    out = level.withColumn("level", F.lit(depth))
    for k in range(depth - 1, -1, -1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("prefix", "hash"))), lambda x: x["hash"])
        level = level.groupBy(F.substring("prefix", 1, k).alias("prefix")).agg(F.sha2(F.array_join(children, "\n"), 256).alias("hash"), F.sum("n").alias("n"))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.select("prefix", "level", "hash", "n")


def corpus_hash(rows: DataFrame, columns: list[str], depth: int | None = None) -> DataFrame:
    """One row: ``corpus_hash, n_rows``, the root of the tree; none for an empty table."""
    return hash_tree(rows, columns, depth).where("level = 0").select(F.col("hash").alias("corpus_hash"), F.col("n").alias("n_rows"))


def fetch_chunk(scope: Scope, documents: DataFrame, chunks: DataFrame, chunk_id: str) -> dict | None:
    """A chunk by id; raises where its document is outside the scope."""
    row = chunks.where(F.col("chunk_id") == chunk_id).limit(1).collect()
    if not row:
        return None
    scope.check(documents, row[0]["doc_id"])
    return row[0].asDict()


def text_timeline(rows: DataFrame, limit: int) -> DataFrame:
    """Rows with a date in their text, the readable ones first, in order of time, document, page and chunk.

    rows: ``doc_id, page, chunk_id, text``. The excerpt starts up to 80 characters before the date and ends 160 after.
    """
    from casewright.functions import dates

    # only the first rows in order are looked at, three for each that is wanted
    looked = rows.orderBy("doc_id", "page", "chunk_id").limit(3 * limit)
    said = looked.withColumn("date_text", dates.first_date(F.col("text"))).where("date_text != ''")
    out = said.withColumn("event_time", dates.parse(F.col("date_text")))
    at = F.greatest(F.lit(1), F.instr("text", F.regexp_extract("text", dates.DATE, 0)) - 80)
    out = out.withColumn("excerpt", F.trim(F.substring("text", at, F.lit(240))))
    return out.orderBy(F.col("event_time").isNull(), "event_time", "doc_id", "page", "chunk_id").limit(limit)


def store_health(spark) -> dict:
    """The number of tables that the session's catalogue knows."""
    return {"tables": len(spark.catalog.listTables())}
