"""The queries ``opN_<name>`` over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import chat, compressive, decontaminate, divergence, jaccardjoin, linkrank, pieces, pivotsearch, repeats, rules, toxicity, variants, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The vocabulary file's place comes from the installed package; nothing is copied."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Fixed values of the url filter's rules: (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), piece_model())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.judge(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkrank.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op3_sentencepiece, op4_decontamination, op9_quality_rules, op10_url_filters)}


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


QUERIES["op5_substring_dedup"] = op5_substring_dedup


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES["op6_jaccard_join"] = op6_jaccard_join


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, prior = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, prior)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, share = compressive.fit(docs, table(spark, sf_dir, "labels"))
    return compressive.score(docs, model, share)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.digests(turns.unionByName(extra))


QUERIES.update({f.__name__: f for f in (op7_toxicity, op8_quality_classifier, op1_warc, op2_chat_formatting)})


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES["op12_source_divergence"] = op12_source_divergence


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


QUERIES["op11_spelling_variants"] = op11_spelling_variants


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotsearch.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


QUERIES["op13_topk_search"] = op13_topk_search
