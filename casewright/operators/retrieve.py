"""Retrievers and rank fusion: exact, BM25, vector, weighted reciprocal ranks, document coverage."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright import config
from casewright.session import written

#: Plates, long numbers and case names that a query names exactly.
EXACT = r"\b[A-Z]{2}\d{2}\s?[A-Z]{3}\b|\+?\d[\d\s]{8,}\d|OP[_\-\s]?[A-Z0-9]+\b"


def exact_tokens(query: str) -> list[str]:
    return re.findall(EXACT, query)


def exact_lookup(aliases: DataFrame, entities: DataFrame, tokens: list[str], limit: int = 20) -> DataFrame:
    """Aliases that a token names in any case, with their entities, score 1; ordered by alias for a stable limit."""
    named = aliases.where(F.lower("alias_text").isin([t.lower() for t in tokens]))
    return named.join(entities, "entity_id").withColumn("score", F.lit(1.0)).orderBy("entity_id", "alias_id").limit(limit)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = config.BM25_K1, b: float = config.BM25_B, most_sent: int = 500_000) -> DataFrame:
    """``query_id, doc_id, score, rank``: the k best documents of each query. docs: doc_id, text; queries: query_id, text.

    Only postings of query terms are kept: the terms of the queries are joined before anything is grouped. They are written once
    and dealt by document, where the queries' terms, sent to them while at most ``most_sent``, meet and are summed: pairs of a
    query and a document are not shuffled, but the k best of each part.
    """
    sent = lambda df: F.broadcast(df) if df.count() <= most_sent else df
    cut = docs.select("doc_id", terms(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    asked = written(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")))
    # the empty term, which no text has, stands for the document itself: its postings give the number of documents and their length
    wanted = asked.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([("",)], "term string"))
    postings = cut.select("doc_id", "len", F.explode(F.array_append("t", F.lit(""))).alias("term")).join(sent(wanted), "term", "left_semi").groupBy("term", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf"))
    postings = written(postings)
    stats = F.broadcast(postings.where("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg_len")))
    postings = postings.where("term != ''")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = asked.join(df, "term")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    met = postings.repartition("doc_id").join(sent(asked), "term").crossJoin(stats)
    scored = met.select("query_id", "doc_id", part.alias("part")).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return _top(scored, "query_id", "score", "doc_id", k)


def contained(items: DataFrame, docs: DataFrame, gram: int = 3, most_sent: int = 500_000) -> DataFrame:
    """``query_id, doc_id``: the documents whose text contains an item's whole text. items: query_id, text; docs: doc_id, text.

    Where an item occurs, its words but the first and last stand in the document as whole words. So each item is looked up by
    ``gram`` consecutive inner words, of all its grams the one that the fewest documents have, and what is found is verified.
    Items with fewer inner words are looked up by one; those without are short, and only they are held against
    every text. An empty item is in no text.
    """
    words = lambda c: F.array_remove(F.split(F.coalesce(c, F.lit("")), r"\s+"), "")
    asked = written(items.select("query_id", F.col("text").alias("whole")).where("whole != ''").withColumn("w", words(F.col("whole"))))
    inner = F.slice("w", F.lit(2), F.greatest(F.lit(0), F.size("w") - 2))
    asked = asked.select("query_id", "whole", inner.alias("w"))

    def grams(of: DataFrame, w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))

    found = None
    for n, part in ((gram, asked.where(F.size("w") >= gram)), (1, asked.where((F.size("w") > 0) & (F.size("w") < gram)))):
        if part.isEmpty():
            continue
        keys = part.select("query_id", F.explode(F.array_distinct(grams(part, F.col("w"), n))).alias("gram"))
        wanted = keys.select("gram").distinct()
        wanted = F.broadcast(wanted) if wanted.count() <= most_sent else wanted
        split = docs.select("doc_id", words(F.col("text")).alias("w"))
        hits = written(split.select("doc_id", F.explode(F.array_distinct(grams(split, F.col("w"), n))).alias("gram")).join(wanted, "gram", "left_semi"))
        often = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        # a gram that no document has rules its item out
        rarest = keys.join(often, "gram", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
        met = rarest.where("r.n > 0").select("query_id", F.col("r.gram").alias("gram")).join(hits, "gram").select("query_id", "doc_id")
        found = met if found is None else found.unionByName(met)
    spark = docs.sparkSession
    found = spark.createDataFrame([], items.select("query_id").join(docs.select("doc_id"), F.lit(False)).schema) if found is None else found
    pairs = written(found.distinct())
    # few pairs go to the texts, which then stay where they are
    near = docs.select("doc_id", "text").join(F.broadcast(pairs) if pairs.count() <= most_sent else pairs, "doc_id")
    sure = near.join(asked.select("query_id", "whole"), "query_id").where(F.contains("text", F.col("whole"))).select("query_id", "doc_id")
    short = asked.where(F.size("w") == 0).select("query_id", "whole")
    if short.isEmpty():
        return sure
    if short.count() > 10_000:
        raise ValueError("over 10,000 items without an inner word")
    return sure.unionByName(docs.select("doc_id", "text").join(F.broadcast(short), F.contains("text", F.col("whole"))).select("query_id", "doc_id"))


def _top(scored: DataFrame, by: str, score: str, tie: str, k: int, ascending: bool = False) -> DataFrame:
    order = F.asc(score) if ascending else F.desc(score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, tie))).where(F.col("rank") <= k)


def squared_l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def balls(vectors: DataFrame, metric: str = "l2", centres: int = 32, seed: int = 17) -> tuple[DataFrame, DataFrame, list[list[float]]]:
    """Vectors with their ``ball``, the balls (``ball, size, radius, n``), and the centres: seeded vectors, of any length.

    Each vector belongs to the nearest centre of its own length (0 where there is none, which bounds nothing). For the cosine
    vectors count as scaled to length 1, and those without a length are left out.
    """
    point = F.col("embedding").cast("array<double>")
    if metric != "l2":
        vectors = vectors.where(dot(F.col("embedding"), F.col("embedding")) > 0)
        point = F.transform(point, lambda x: x / F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
    # at most ``centres`` vectors
    chosen = [list(r.p) for r in vectors.where("embedding is not null").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(centres).select(point.alias("p")).collect()]
    placed = vectors.where("embedding is not null").withColumn("point", point)
    far = F.array(*[F.when(F.size("point") == len(c), _apart(F.col("point"), F.lit(c))).otherwise(F.lit(float("inf"))) for c in chosen]) if chosen else F.array(F.lit(float("inf")))
    placed = written(placed.withColumn("far", far).withColumn("gap", F.array_min("far")).withColumn("ball", F.when(F.col("gap") < float("inf"), F.array_position("far", F.col("gap")).cast("int")).otherwise(0)).drop("far"))
    each = placed.groupBy("ball", F.size("point").alias("size")).agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n"))
    return placed, written(each), chosen


def _nearest(queries: pd.DataFrame, vectors: pd.DataFrame, k: int, metric: str, block: int = 128) -> pd.DataFrame:
    """``query_id, vec_id, distance``: for each query the vectors that may be among its ``k`` nearest of a part of a ball.

    A matrix product chooses all that lie within its error and the rounding of the k-th; their distances are then summed
    component by component. Of equal distances the ``k`` smallest vec_ids are enough.
    """
    out = {"query_id": [], "vec_id": [], "distance": []}
    if len(queries) and len(vectors):
        vectors = vectors.sort_values("vec_id")
        ids, names = vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        v, q = (np.stack(c.to_numpy()).astype("float64") for c in (vectors["embedding"], queries["query"]))
        vv, qq = _summed(v * v), _summed(q * q)
        for at in range(0, len(q), block):
            some = slice(at, at + block)
            with np.errstate(all="ignore"):
                cross = q[some] @ v.T
                far = qq[some, None] + vv - 2 * cross if metric == "l2" else 1 - cross / np.sqrt(qq[some, None] * vv)
                error = 2e-6 + 1e-12 * (qq[some, None] + vv.max() if metric == "l2" else 1.0)
                kth = np.partition(far, k - 1, axis=1)[:, k - 1 : k] if len(ids) > k else np.full((len(far), 1), np.nan)
                i, j = np.nonzero(~(far > kth + error))
                a, b = q[at + i], v[j]
                d = _summed((b - a) * (b - a)) if metric == "l2" else 1 - _summed(b * a) / np.sqrt(vv[j] * qq[at + i])
            # vec_ids grow with j
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            new = np.r_[True, (i[1:] != i[:-1]) | ((d[1:] != d[:-1]) & ~(np.isnan(d[1:]) & np.isnan(d[:-1])))] if len(i) else np.zeros(0, bool)
            first = np.nonzero(new)[0]
            keep = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
            out["query_id"].append(names[at + i[keep]])
            out["vec_id"].append(ids[j[keep]])
            out["distance"].append(d[keep])
    if not out["distance"]:
        return pd.DataFrame({"query_id": queries["query_id"].iloc[:0].reset_index(drop=True), "vec_id": vectors["vec_id"].iloc[:0].reset_index(drop=True), "distance": np.zeros(0)})
    return pd.DataFrame({c: np.concatenate(parts) for c, parts in out.items()})


def _summed(m: np.ndarray) -> np.ndarray:
    """The sum of each row, from left to right."""
    total = np.zeros(len(m))
    for c in range(m.shape[1]):
        total += m[:, c]
    return total


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", centres: int = 32, part: int = 20_000) -> DataFrame:
    """``query_id, vec_id, distance, similarity, rank``: a stated set of query vectors against all vectors.

    Vectors lie in balls around seeded centres. A query first meets the ball whose centre is nearest, which bounds its k-th
    distance; then only balls that can reach inside that bound, by the triangle inequality. Balls of very many vectors are met
    in parts of about ``part``. Vectors of another length than the query's are left out, and so are those with a null component.
    """
    vectors, queries = vectors.where(~F.exists("embedding", F.isnull)), queries.where(~F.exists("query", F.isnull))
    placed, each, chosen = balls(vectors, metric, centres)
    each = each.withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    keyed = placed.withColumn("size", F.size("point")).join(F.broadcast(each.select("ball", "size", "parts")), ["ball", "size"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    asks = _bounds(queries, each, chosen, metric)

    # queries that meet a part of a ball are dealt too, so that no group grows with the queries
    shares = max(1, -(-asks.select("query_id").distinct().count() // part))
    share = F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int").alias("share")
    vectors_of = keyed.select("ball", "size", "part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "vec_id", "embedding")
    kinds = {f.name: f.dataType.simpleString() for f in [*asks.schema, *keyed.schema]}

    def meet(pairs: DataFrame) -> DataFrame:
        dealt = pairs.select("ball", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), share, "query_id", "query")
        by = ["ball", "size", "part", "share"]
        near = dealt.groupBy(*by).cogroup(vectors_of.groupBy(*by)).applyInPandas(
            lambda q, v: _nearest(q, v, k, metric), f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, distance double"
        )
        scored = near.select("query_id", "vec_id", F.round("distance", 6).alias("distance"))
        return _top(scored, "query_id", "distance", "vec_id", k, ascending=True).drop("rank")

    first = written(meet(asks.where("place = 1")))
    rest = meet(remaining(asks, first, k, metric))
    found = _top(first.unionByName(rest), "query_id", "distance", "vec_id", k, ascending=True)
    return found.select("query_id", "vec_id", "distance", "rank").withColumn("similarity", F.round(1 / (1 + F.greatest("distance", F.lit(0.0))), 6))


def _bounds(queries: DataFrame, each: DataFrame, chosen: list[list[float]], metric: str) -> DataFrame:
    """``query_id, query, ball, size, parts, bound, place``: the least distance of a query to a ball's vectors, nearest centres first."""
    point = F.col("query").cast("array<double>")
    asked = queries.where("query is not null")
    if metric != "l2":
        asked = asked.where(dot(F.col("query"), F.col("query")) > 0)
        point = F.transform(point, lambda x: x / F.sqrt(dot(F.col("query"), F.col("query"))))
    far = F.array(F.lit(0.0), *[F.when(F.size("p") == len(c), _apart(F.col("p"), F.lit(c))).otherwise(F.lit(0.0)) for c in chosen])
    # the balls are at most one for each centre, and one for each length without centre
    asked = asked.withColumn("p", point).withColumn("far", far).withColumn("size", F.size("p")).join(F.broadcast(each), "size")
    gap = F.get("far", F.col("ball"))
    out = asked.withColumn("bound", F.when(F.col("ball") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), gap - F.col("radius"))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(gap, "ball"))
    return written(out.withColumn("place", place).select("query_id", "query", "ball", "size", "parts", "bound", "place"))


def remaining(asks: DataFrame, first: DataFrame, k: int, metric: str) -> DataFrame:
    """The further balls that a query has to meet: all while it has no k vectors, else those whose bound reaches its k-th distance."""
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"), F.max("distance").alias("kth"))
    # distances are rounded to six places; a cosine distance is half the square of the distance of the unit vectors
    reach = F.sqrt(F.greatest(F.lit(0.0), F.col("kth") * (1.0 if metric == "l2" else 2.0)) + F.lit(2e-6)) + F.lit(1e-9) * (1 + F.col("bound"))
    return asks.where("place > 1").join(kth, "query_id", "left").where((F.coalesce("have", F.lit(0)) < k) | (F.col("bound") <= reach))


def result_key(source: Column, rel: Column, entity: Column, doc: Column, chunk: Column, ordinal: Column) -> Column:
    """What makes two candidates the same result."""
    where = F.coalesce(doc, chunk, ordinal.cast("string"))
    return (
        F.when((source == "graph") & rel.isNotNull(), F.concat_ws(":", F.lit("graph"), rel, where))
        .when((source == "exact") & entity.isNotNull(), F.concat_ws(":", F.lit("exact"), entity, where))
        .when(chunk.isNotNull(), F.concat_ws(":", F.lit("chunk"), chunk))
        .when(rel.isNotNull(), F.concat_ws(":", source, F.lit("rel_id"), rel))
        .when(entity.isNotNull(), F.concat_ws(":", source, F.lit("entity_id"), entity))
        .otherwise(F.concat_ws(":", source, F.lit("item"), ordinal.cast("string")))
    )


def _by_source(table: dict[str, float], default: float) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(F.col("source") == name, F.lit(value)) if out is None else out.when(F.col("source") == name, F.lit(value))
    return out.otherwise(F.lit(default))


def learned(ranked: DataFrame, model) -> DataFrame:
    """Fused rows with rank_score from a learned model: a function from a frame of the score features to scores."""
    names = ranked.schema["score_features"].dataType.names

    @F.pandas_udf("double")
    def run(features: pd.DataFrame) -> pd.Series:
        return pd.Series(model(features[names]), dtype="float64")

    return ranked.withColumn("rank_score", run(F.col("score_features")))


def resolve_names(entities: DataFrame, names: list[str]) -> DataFrame:
    """Entities whose name is one of ``names`` as it stands or in the normal form of any type, in any case."""
    from casewright.functions.normalise import STRATEGIES

    spark = entities.sparkSession
    asked = spark.createDataFrame([(n.strip(),) for n in names if n and n.strip()], "raw string")
    forms = asked.select(F.explode(F.array_distinct(F.array(F.col("raw"), *[f(F.col("raw")) for f in STRATEGIES.values()]))).alias("form")).select(F.lower("form").alias("form")).where("form != ''").distinct()
    return entities.join(F.broadcast(forms), F.lower("canonical_name") == forms["form"], "left_semi")


def fuse(candidates: DataFrame, weights: dict[str, float] | None = None, k: int = config.RRF_K) -> DataFrame:
    """One row for each query and key: the best candidate with rank_score, evidence_count, supporting_sources, score_features.

    candidates: ``query_id, source, key, score, ordinal`` and anything else. A source's candidates are ranked by score,
    earlier ones first in a tie; a key's score is the sum of weight / (k + rank) over all its candidates.
    """
    w = _by_source(config.SOURCE_WEIGHTS | (weights or {}), 1.0)
    priority = _by_source({s: float(p) for s, p in config.SOURCE_PRIORITY.items()}, 0.0)
    rank = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "ordinal"))
    rows = candidates.withColumns({"w": w, "priority": priority}).withColumn("rank", rank).withColumn("part", F.col("w") / (k + F.col("rank")))
    held = F.struct(*[F.col(c) for c in candidates.columns if c not in ("query_id", "key")], "w", "priority")
    merged = rows.groupBy("query_id", "key").agg(
        F.sum("part").alias("rrf"), F.count(F.lit(1)).alias("evidence_count"), F.array_sort(F.collect_set("source")).alias("supporting_sources"),
        F.max("score").alias("max_base_score"), F.max_by(held, F.struct(F.col("score") * F.col("w"), F.col("priority"), F.col("score"), -F.col("ordinal"))).alias("best"),
    )
    rrf = F.round("rrf", 9)
    features = F.struct(rrf.alias("rrf_score"), F.col("best.score").alias("base_score"), "max_base_score", F.col("evidence_count").cast("double").alias("evidence_count"), F.col("best.w").alias("source_weight"), F.col("best.priority").alias("source_priority"))
    plain = [F.col(f"best.{c}").alias(c) for c in candidates.columns if c not in ("query_id", "key", "ordinal")]
    return merged.select("query_id", "key", rrf.alias("rank_score"), *plain, F.col("best.priority").alias("priority"), "evidence_count", "supporting_sources", features.alias("score_features"))


def ranked_order() -> list[Column]:
    """The order of what ``fuse`` returns: by rank_score, of equal ones by the source's priority, then base score, then key."""
    return [F.desc("rank_score"), F.desc("priority"), F.desc("score"), F.asc("key")]


def cover_documents(ranked: DataFrame, top_n: int, least_docs: int) -> DataFrame:
    """The top rows of each query, with rows of unseen documents put in for the lowest of documents that have several.

    ranked: ``query_id, key, doc_id, rank_score`` and maybe ``priority, score`` of a bounded number of candidates a query.
    """
    ties = [c for c in ("priority", "score") if c in ranked.columns]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["rank_score", *ties, "key"], ascending=[False] * (1 + len(ties)) + [True]).reset_index(drop=True)
        chosen, rest = list(range(min(top_n, len(rows)))), list(range(top_n, len(rows)))
        doc, score = rows["doc_id"].tolist(), rows["rank_score"].tolist()
        for i in rest:
            seen = {doc[c] for c in chosen}
            if len(seen) >= least_docs:
                break
            if doc[i] in seen:
                continue
            many = [c for c in chosen if sum(doc[o] == doc[c] for o in chosen) > 1]
            if not many:
                break
            chosen[chosen.index(min(many, key=lambda c: (score[c], -c)))] = i
        return rows.loc[sorted(chosen)].drop(columns=ties)

    cols = ranked.select("query_id", "key", "doc_id", "rank_score", *ties)
    return cols.groupBy("query_id").applyInPandas(run, cols.drop(*ties).schema)


def recall_mode(mode: str, wants_recall: bool, default: str = "balanced") -> tuple[str, int, int]:
    """(mode, candidate multiplier, least documents); "auto" is balanced where recall is asked for, else fast."""
    chosen = mode if mode in config.RECALL else ("balanced" if wants_recall or default != "fast" and mode != "auto" else "fast")
    return chosen, *config.RECALL[chosen]
