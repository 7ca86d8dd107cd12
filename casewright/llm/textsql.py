"""Column expressions for words and shingles; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between words: space, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]+"
LETTER = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once for a row, also where filters are moved and columns put into one another."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(words_: Column, n: int) -> Column:
    """A 64-bit hash of each ``n`` consecutive words, in order; an empty array for fewer words."""

    def hashes(w: Column) -> Column:
        size = F.size(w)
        starts = F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))

    return let(words_, hashes)


def ascii_lower(text: Column) -> Column:
    """Only A-Z are lower-cased, by a byte-wise pass where the text has no other letters."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
