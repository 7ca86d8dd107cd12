"""Spelling variant grouping: each word's near words, its standard form, and the root that its forms lead to.

Two words are near if one inserted, deleted or replaced code point turns one into the other. No pair of words is ever
formed for replacements: each word is sent to one wildcard group for each of its positions, keyed by (position, prefix,
suffix); all words of a group differ from each other at just that position, so the group's size and its top two words
tell every member how many replacements it has there and which is the best. Insertions and deletions come from joining
each word's deletions with the vocabulary; a hit counts for both of its words. Both are added up by word.

Words are numbered by falling count, then code points, so that "the near word of largest n, the smallest in a tie" is
the smallest number. A group holds at most as many words as there are characters. Words of over 64 code points, whose
positions times length would grow with the square, are keyed by SHA-256 digests of prefix and suffix instead, which one
pass gives for all positions; the digests are taken as the strings that they stand for.

Null texts have no words. A null doc_id counts as ''. Repeated rows count each. Columns but doc_id and text are not read.
Without words the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm.shared import cut, work_path
from casewright.llm.textsql import ascii_lower

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Longest word whose keys are strings.
PLAIN = 64


def vocabulary(docs: DataFrame, least_length: int = 7, least_uses: int = 2, every: int = 31) -> DataFrame:
    """``word, n``: maximal runs of letters; where ``every`` divides the crc32 of ``<doc_id>:<run>`` one letter is dropped."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    # a dropped letter only shortens, so shorter runs can be left out at once
    runs = F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    got = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    got = got.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    dropped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = got.select(F.when(F.col("h") % every == 0, dropped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_uses)


def _long_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of words from PLAIN code points on: kind "r" and "d" without a position, "i" with a gap before one."""

    def digests(chars: Iterator[str]) -> list[bytes]:
        h = hashlib.sha256()
        out = [h.digest()]
        for c in chars:
            h.update(c.encode())
            out.append(h.digest())
        return out

    def keys(word: str) -> Iterator[tuple[str, str]]:
        before, after = digests(iter(word)), digests(reversed(word))[::-1]
        name = lambda i, j: f"#{i}:{hashlib.sha256(before[i] + after[j]).hexdigest()}"
        for i in range(len(word) + 1):
            yield "i", name(i, i)
            if len(word) > PLAIN and i < len(word):
                yield "r", name(i, i + 1)
                if i == 0 or word[i] != word[i - 1]:
                    yield "d", name(i, i + 1)

    for batch in batches:
        for word, rank in zip(batch.column(0), batch.column(1), strict=True):
            kind, key = [], []
            for k, x in keys(word.as_py()):
                kind.append(k)
                key.append(x)
                if len(key) == 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array([rank.as_py()] * len(key))], names=["kind", "key", "rank"])
                    kind, key = [], []
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array([rank.as_py()] * len(key))], names=["kind", "key", "rank"])


def near_words(words: DataFrame) -> DataFrame:
    """``rank, n_near, best`` for words (``rank, word``) that have near words; ``best`` is the smallest rank among them."""
    size = F.length("word")
    short = words.where(size <= PLAIN)
    spots = F.sequence(F.lit(0), size - 1)
    before, after = lambda i: F.substring("word", F.lit(1), i), lambda i: F.substring("word", i + 2, F.length("word"))
    without = lambda i: F.concat(before(i), after(i))
    letter = lambda i: F.substring("word", i + 1, F.lit(1))
    long = words.where(size >= PLAIN).select("word", "rank").mapInArrow(_long_keys, "kind string, key string, rank long")

    groups = short.select("rank", F.explode(F.transform(spots, lambda i: F.concat(i.cast("string"), F.lit(":"), without(i)))).alias("key"))
    groups = groups.unionByName(long.where("kind = 'r'").select("rank", "key"))
    group = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = groups.select("rank", F.count(F.lit(1)).over(group).alias("size"), F.first("rank").over(group).alias("top"), F.nth_value("rank", 2).over(group).alias("second"))
    replaced = seen.where("size > 1").select("rank", (F.col("size") - 1).alias("n"), F.when(F.col("rank") == F.col("top"), F.col("second")).otherwise(F.col("top")).alias("best"))

    # of equal letters in a row only the first is dropped, so that a word's deletions are distinct
    drops = F.filter(spots, lambda i: (i == 0) | (letter(i) != letter(i - 1)))
    deleted = short.select("rank", F.explode(F.transform(drops, lambda i: F.concat(F.lit("="), without(i)))).alias("key"))
    deleted = deleted.unionByName(long.where("kind = 'd'").select("rank", "key"))
    held = short.select(F.concat(F.lit("="), "word").alias("key"), F.col("rank").alias("other")).unionByName(long.where("kind = 'i'").select("key", F.col("rank").alias("other")))
    hits = deleted.join(held, "key").select(F.explode(F.array(F.struct("rank", F.col("other").alias("best")), F.struct(F.col("other").alias("rank"), F.col("rank").alias("best")))).alias("s"))
    hits = hits.select("s.rank", F.lit(1).cast("long").alias("n"), "s.best")
    return replaced.unionByName(hits).groupBy("rank").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for distinct words ``word, n``.

    A form has at least ``ratio`` times the word's n, so a chain of forms is no longer than the digits of the largest n.
    """
    path = work_path(words.sparkSession, "variants")
    # after a distributed sort these numbers grow in its order
    words.select("word", "n").orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("rank"), "word", "n").write.parquet(f"{path}/words")
    held = words.sparkSession.read.parquet(f"{path}/words")
    near_words(held).write.parquet(f"{path}/near")
    near = words.sparkSession.read.parquet(f"{path}/near")
    of = lambda name: held.select(F.col("rank").alias(f"{name}_rank"), F.col("word").alias(name), F.col("n").alias(f"{name}_n"))
    full = held.join(near, "rank", "left").join(of("form"), F.col("best") == F.col("form_rank"), "left")
    has = F.col("form_n") >= ratio * F.col("n")
    full = full.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(has, F.col(c)).alias(c) for c in ("form", "form_n", "form_rank")])
    roots = _roots(full.where("form_rank is not null").select("rank", F.col("form_rank").alias("root_rank")))
    full = full.join(roots, "rank", "left").join(of("root"), "root_rank", "left")
    return full.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(parents: DataFrame, most_rounds: int = 8) -> DataFrame:
    """``rank, root_rank``: each round doubles how far a rank looks along its forms."""
    roots = cut(parents)
    for _ in range(most_rounds):
        ahead = roots.select(F.col("rank").alias("root_rank"), F.col("root_rank").alias("ahead"))
        if roots.join(ahead, "root_rank", "left_semi").isEmpty():
            return roots
        roots = cut(roots.join(ahead, "root_rank", "left").select("rank", F.coalesce("ahead", "root_rank").alias("root_rank")))
    raise RuntimeError(f"forms still lead on after {most_rounds} rounds of doubling")


def variants(docs: DataFrame, least_length: int = 7, least_uses: int = 2, every: int = 31, ratio: int = 10) -> DataFrame:
    """Vocabulary of the texts with near words, forms and roots."""
    spark = docs.sparkSession
    path = work_path(spark, "vocabulary")
    vocabulary(docs, least_length, least_uses, every).write.parquet(path)
    return group_variants(spark.read.parquet(path), ratio)
