"""Text expressions: cleaning, tokens, windows, excerpts, redaction, sentences, boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright import config

# Words that say nothing, denials, redaction marks.
STOPWORDS = ["about", "after", "also", "been", "being", "from", "have", "into", "known", "that", "their", "there", "they", "this", "with", "were", "what", "when", "where"]
DENIAL = r"(?i)\b(?:denied|denies|deny|no\s+known|not\s+known|unknown\s+to|no\s+connection|no\s+link|unconnected|not\s+associated)\b"
DENIAL_CLAIM = r"(?i)\b(?:denied|denies|deny|did\s+not\s+know|does\s+not\s+know|no\s+known|not\s+known|no\s+connection|no\s+link|unconnected)\b"
REDACTION = r"(?i)(\[redacted\]|\bredacted\b|█{2,}|■{2,}|_{6,}|-{6,})"


def clean(text: Column) -> Column:
    """Without control characters; tabs and line ends stay."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def count_tokens(text: Column) -> Column:
    """0 for the empty text, else the number of white-space tokens, one at least."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.size(tokens(text))))


def word_set(text: Column) -> Column:
    """Distinct lower-case words of three characters at least that are no stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS)))


def overlap_ratio(left: Column, right: Column) -> Column:
    """The share of the left text's words that the right text has; 0 without words."""
    a = word_set(left)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, word_set(right))) / F.size(a))


def excerpt(text: Column, most: int = 220) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def sentences(text: Column) -> Column:
    return F.array_remove(F.transform(F.split(text, r"(?<=[.!?])\s+|;\s+"), lambda s: F.trim(s)), "")


def redactions(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(REDACTION))


def chunk_windows(pages: DataFrame, target: int = config.CHUNK_TOKENS, overlap: int = config.CHUNK_OVERLAP) -> DataFrame:
    """``doc_id, page, chunk_index, text, token_count``: overlapping windows of each page's tokens.

    A page's last window is the first that reaches its end; chunk_index runs on across a document's pages.
    pages: ``doc_id, page, text``.
    """
    if target <= 0:
        raise ValueError("the target has to be positive")
    stride = max(1, target - overlap)
    cut = pages.select("doc_id", "page", tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("t") - F.lit(target)) / F.lit(stride)).cast("int"))
    parts = cut.select("doc_id", "page", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("t", k * stride + 1, F.lit(target)))).alias("part", "w"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "part"))
    return parts.select("doc_id", "page", (order - 1).alias("chunk_index"), F.array_join("w", " ").alias("text"), F.size("w").alias("token_count"))


def is_boilerplate(text: Column, phrases: list[str]) -> Column:
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    shouted = (letters > 0) & (upper / F.greatest(letters, F.lit(1)) > 0.7) & (F.length(text) < 220)
    named = F.lit(False)
    for p in phrases:
        named = named | F.lower(text).contains(p)
    return named | (F.regexp_count(text, F.lit(r"\|")) >= 2) | shouted


def html_text(html: Column) -> Column:
    """A page's text: no scripts, styles, comments or tags; five entities read; white space folded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n\f]+", " "))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")
