"""Files of other kinds: fingerprints, routing by suffix, extractor hooks, quality of pages, positions of pictures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import text

# Suffixes by kind.
SUFFIXES = {
    "pdf": ["pdf"],
    "table": ["csv", "tsv"],
    "image": ["jpg", "jpeg", "png", "bmp", "tif", "tiff"],
    "audio_video": ["aac", "aiff", "avi", "flac", "m4a", "mkv", "mov", "mp3", "mp4", "mpeg", "mpg", "ogg", "wav", "webm", "wma"],
    "thread": ["parquet"],
    "mail": ["eml", "msg"],
}


def kind_of(path: Column) -> Column:
    """The kind of a file by its suffix; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, names in SUFFIXES.items():
        out = F.when(suffix.isin(names), F.lit(kind)).otherwise(out)
    return out


def fingerprints(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``filepath, source_hash, source_size_bytes, modified, kind`` of a folder's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select(F.col("path").alias("filepath"), F.sha2("content", 256).alias("source_hash"), F.col("length").alias("source_size_bytes"), F.col("modificationTime").alias("modified"), kind_of(F.col("path")).alias("kind"))


def extract_pages(files: DataFrame, extractor: Callable[[str, bytes], list[tuple[int, str]]] | None = None, least_chars: int = 50) -> DataFrame:
    """``filepath, page, text, needs_ocr``: pages by a hook for a file format; without a hook no file has pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, n, t) for p, c in zip(b["path"], b["content"], strict=True) for n, t in (extractor(p, c) if extractor else [])]
            yield pd.DataFrame(rows, columns=["filepath", "page", "text"])

    pages = files.select("path", "content").mapInPandas(run, "filepath string, page int, text string")
    return pages.withColumn("text", text.clean(F.col("text"))).withColumn("needs_ocr", F.length(F.trim("text")) < least_chars)


def redaction_boxes(rects: DataFrame) -> DataFrame:
    """``doc_id, page, redactions`` of rectangles of 8 by 8 at least that are filled nearly black."""
    return rects.where("width >= 8 and height >= 8 and fill <= 0.03").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("redactions"))


def redaction_note(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("[REDACTION: "), n.cast("string"), F.lit(" region(s)]")))


def ocr_quality(confidences: Column, least: float = 0.6) -> tuple[Column, Column]:
    """(mean of the confidences from 0 to 100 as a share, whether the page needs review)."""
    valid = F.filter(confidences, lambda c: (c >= 0) & (c <= 100))
    score = F.when(F.size(valid) > 0, F.aggregate(valid, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(valid) / 100)
    return score, F.coalesce(score < least, F.lit(True))


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column, most: int) -> Column:
    """Degrees with the sign of the hemisphere; null outside the range."""
    d = degrees + minutes / 60 + seconds / 3600
    d = F.when(F.upper(F.trim(ref)).substr(1, 1).isin("S", "W"), -d).otherwise(d)
    return F.when(d.between(-most, most), d)


#: Case references by how a file's name begins.
CASES = {"OP_IRONVALE": "OP_IRONVALE", "OP_SEAGLASS": "OP_SEAGLASS", "NF-": "OP_NIGHTFALL", "OC-": "OP_CHESTER"}


def infer_case(filename: Column, cases: dict[str, str] | None = None, default: str = "UNASSIGNED") -> Column:
    out = F.lit(default)
    for start, case in reversed((cases or CASES).items()):
        out = F.when(filename.startswith(start), F.lit(case)).otherwise(out)
    return out
