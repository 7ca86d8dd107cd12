"""Dates in text: find, read, and order them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a date in text, and the formats that are tried in order.
DATE = (
    r"(?i)\b(?:(?:(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)[,\s]+\d{1,2}(?:st|nd|rd|th)?(?:[,\s]+\d{2,4})?)"
    r"|(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)(?:day)?[,\s]+)?(?:\d{1,2}(?:st|nd|rd|th)?[,\s]+)?(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)(?:[,\s]+\d{2,4})?"
    r"|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{4}[/\-]\d{2}[/\-]\d{2})"
    r"(?:[T,\s]+(?:\d{1,2}:\d{2}(?::\d{2})?(?:\s*[APap][Mm])?))?\b"
)
#: A date's shape and the formats of its day; each may be followed by a time.
SHAPES = [(r"^\d{4}-", ["yyyy-M-d"]), (r"^\d{4}/", ["yyyy/M/d"]), (r"^\d{1,2}/", ["d/M/yyyy"]), (r"^\d{1,2}-", ["d-M-yyyy"]), (r"^\d{1,2} [A-Za-z]{4,} ", ["d MMMM yyyy"]), (r"^\d{1,2} [A-Za-z]{3} ", ["d MMM yyyy", "d MMMM yyyy"]), (r"^[A-Za-z]{4,} ", ["MMMM d, yyyy"]), (r"^[A-Za-z]{3} ", ["MMM d, yyyy", "MMMM d, yyyy"])]
MAIL = ["d MMM yyyy H:m:s", "d MMM yyyy H:m", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "d/M/yyyy H:m", "yyyy-M-d"]


def first_date(text: Column) -> Column:
    """The first date in a text with the time after it where that stands within eight characters; '' without one."""
    found = F.regexp_extract(text, DATE, 0)
    after = F.regexp_extract(text, f"(?is){DATE[4:]}(.{{0,32}})", 1)
    late = F.regexp_extract(after, rf"(?is)^.{{0,8}}?\b(\d{{1,2}}:\d{{2}}(?::\d{{2}})?(?:\s*[ap]m)?)\b", 1)
    return F.when((found != "") & ~found.rlike(r"\d:\d") & (late != ""), F.concat_ws(" ", found, late)).otherwise(found)


def tidy(text: Column) -> Column:
    """Without weekday, "at", ordinal endings and a trailing Z; a T between date and time is a space."""
    t = F.regexp_replace(F.trim(text), r"(?i)^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)(?:day)?[,\s]+", "")
    t = F.regexp_replace(t, r"(?i)\s+at\s+", " ")
    t = F.regexp_replace(t, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1")
    t = F.regexp_replace(t, r"(\d)T(\d)", "$1 $2")
    return F.regexp_replace(F.regexp_replace(t, r"Z$", ""), r"\s+", " ")


def parse(text: Column, formats: list[str] | None = None) -> Column:
    """The first format that reads the whole text, as a timestamp without zone; null if none does."""
    t = tidy(text)
    if formats is not None:
        return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]).cast("timestamp_ntz")
    # a text's shape leaves one or two formats to try; a format that fails costs far more than a pattern
    out = F.lit(None).cast("timestamp")
    clock = [(r":\d{1,2}:\d{1,2}$", " H:m:s"), (r":\d{1,2}$", " H:m")]
    for shape, days in SHAPES:
        read = lambda end: F.coalesce(*[F.try_to_timestamp(t, F.lit(d + end)) for d in days])  # noqa: E731, B023
        one = F.when(t.rlike(clock[0][0]), read(clock[0][1])).when(t.rlike(clock[1][0]), read(clock[1][1])).otherwise(read(""))
        out = F.when(t.rlike(shape), one).otherwise(out)
    return out.cast("timestamp_ntz")


def mail_timestamp(text: Column) -> Column:
    """RFC-2822 dates and four plain forms."""
    t = F.regexp_replace(tidy(text), r"\s+(?:[+-]\d{4}|GMT|UTC)(?:\s*\([^)]*\))?$", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in MAIL]).cast("timestamp_ntz")
