"""Message threads from Parquet and mail files."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import dates, text

MESSAGE = "array<struct<sender:string,recipients:array<string>,timestamp:string,subject:string,body:string>>"


def messages(raw: Column) -> Column:
    """A JSON list of messages; anything else than a list gives none."""
    listed = F.ltrim(F.coalesce(raw, F.lit(""))).startswith("[")
    return F.when(listed, F.filter(F.coalesce(F.from_json(raw, MESSAGE), F.array().cast(MESSAGE)), lambda m: m.isNotNull())).otherwise(F.array().cast(MESSAGE))


def address(raw: Column) -> Column:
    """The address between <> or [], else a bare address, in lower case; '' without one."""
    inner = F.regexp_extract(raw, r"<([^<>\s]+@[^<>\s]+)>", 1)
    boxed = F.regexp_extract(raw, r"\[([^\[\]\s]+@[^\[\]\s]+)\]", 1)
    bare = F.regexp_extract(raw, r"([^\s<>\[\],;]+@[^\s<>\[\],;]+)", 1)
    return F.lower(F.coalesce(F.nullif(inner, F.lit("")), F.nullif(boxed, F.lit("")), bare))


def label(raw: Column) -> Column:
    """The name without the address; else the address, else the raw text."""
    name = F.trim(F.regexp_replace(F.regexp_replace(raw, r"<[^>]*>|\[[^\]]*\]", ""), r"[\"']", ""))
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(address(raw), F.lit("")), F.trim(raw))


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """One row a message: ``filename`` is ``source#thread=id``, pages count from 1."""
    t = spark.read.parquet(path).select("thread_id", "source_file", "subject", F.posexplode(messages(F.col("messages"))).alias("pos", "m"))
    return t.select(F.concat(F.col("source_file"), F.lit("#thread="), F.col("thread_id")).alias("filename"), "thread_id", "source_file", (F.col("pos") + 1).alias("page"), F.coalesce("m.subject", "subject").alias("subject"), F.col("m.sender").alias("sender"), F.col("m.recipients").alias("recipients"), F.col("m.timestamp").alias("sent"), dates.mail_timestamp(F.col("m.timestamp")).alias("event_time"), F.col("m.body").alias("body"))


def message_text(rows: DataFrame) -> DataFrame:
    """``rows`` with the text of each message under a fixed heading."""
    line = lambda name, c, other: F.concat(F.lit(f"{name}: "), F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other)))
    body = F.concat_ws("\n", line("Thread", F.col("thread_id"), "unknown"), line("Source", F.col("source_file"), "unknown"), line("Subject", F.col("subject"), "(no subject)"), line("From", F.col("sender"), "unknown"), line("To", F.array_join("recipients", ", "), "unknown"), line("Sent", F.col("sent"), "unknown"), F.lit(""), F.coalesce("body", F.lit("")))
    return rows.withColumn("text", body).withColumn("span_text", text.excerpt(F.coalesce("body", F.lit(""))))


def message_edges(rows: DataFrame) -> DataFrame:
    """An edge from the sender to every recipient; null ends and loops go."""
    return rows.withColumn("recipient", F.explode("recipients")).where("sender is not null and recipient is not null and sender != recipient").withColumn("relation_type", F.lit("EMAILED")).withColumn("confidence", F.lit(1.0))


def parse_mail(raw: bytes) -> dict:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    people = lambda name: [str(a) for h in m.get_all(name, []) for a in getattr(h, "addresses", ())]
    plain = m.get_body(preferencelist=("plain",))
    rich = m.get_body(preferencelist=("html",))
    body = plain.get_content() if plain else (rich.get_content() if rich else "")
    return {"subject": str(m["Subject"] or ""), "sender": str(m["From"] or ""), "recipients": people("To") + people("Cc") + people("Bcc"), "sent": str(m["Date"] or ""), "body": body, "is_html": plain is None and rich is not None, "attachments": [p.get_filename() or "" for p in m.iter_attachments()]}


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """One row a mail file; an html body is turned into text."""
    schema = "path string, subject string, sender string, recipients array<string>, sent string, body string, is_html boolean, attachments array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"path": p} | parse_mail(c) for p, c in zip(b["path"], b["content"], strict=True)], columns=[c.split()[0] for c in schema.split(", ")])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
    return rows.withColumn("body", F.when(F.col("is_html"), text.html_text(F.col("body"))).otherwise(F.col("body"))).withColumn("event_time", dates.mail_timestamp(F.col("sent")))
