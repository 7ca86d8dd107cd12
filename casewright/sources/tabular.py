"""Delimited files as evidence rows."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.functions import text


def sniff(head: str) -> str:
    """The delimiter of a file's first characters, a comma if none can be told."""
    try:
        return csv.Sniffer().sniff(head[:4096], delimiters=",\t;|").delimiter
    except csv.Error:
        return ","


def row_text(columns: dict[str, Column]) -> Column:
    """``"name: value | name: value"`` without blank values."""
    return F.concat_ws(" | ", *[F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), F.trim(c))) for name, c in columns.items()])


def read_rows(spark: SparkSession, path: str, sep: str | None = None, max_rows: int | None = None) -> DataFrame:
    """``page, text, token_count``: a file's rows, all values as strings; empty rows go but keep their number.

    Rows are numbered by their place in the file: each partition's count is summed up first, so nothing is
    gathered in one task.
    """
    if sep is None:
        sep = sniff("\n".join(r[0] for r in spark.read.text(path).limit(20).collect()))
    raw = spark.read.csv(path, header=True, sep=sep, inferSchema=False, quote='"', escape='"')
    names = raw.columns
    placed = raw.select(row_text({c: F.col(f"`{c}`") for c in names}).alias("text"), F.monotonically_increasing_id().alias("_id"))
    part = F.shiftright("_id", 33)
    before = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = placed.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("page", (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int"))
    if max_rows is not None:
        rows = rows.where(F.col("page") <= max_rows)
    return rows.where("text != ''").select("page", "text", text.count_tokens(F.col("text")).alias("token_count"))
