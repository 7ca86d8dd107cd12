"""Streaming forms of ingest: files that arrive are taken once, events are counted in windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_documents(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest_new(source: DataFrame, sink: str, checkpoint: str, key: str = "source_hash", transform: Callable[[DataFrame], DataFrame] | None = None, ledger: str | None = None, buckets: int = 256) -> StreamingQuery:
    """Append rows whose key is not in the sink yet; rows without a key are taken as they come.

    The keys taken so far stand in a ledger beside the sink, by hash bucket, so a batch reads only the buckets that its own
    keys fall in. Sink and ledger hold each batch under its own name, made of the checkpoint and the batch number: one that
    runs again after a failure overwrites what it had written and is not held against itself, so nothing is lost or
    taken twice; a stream with a new checkpoint adds to the same sink only what is new.
    """
    ledger = ledger or f"{sink.rstrip('/')}-ledger"
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(rows: DataFrame, number: int) -> None:
        spark, name = rows.sparkSession, f"{run}-{number}"
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        keyed = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("_bucket", bucket)
        # at most ``buckets`` numbers
        met = [r["_bucket"] for r in keyed.select("_bucket").distinct().collect()]
        try:
            held = spark.read.schema(f"`{key}` {dict(rows.dtypes)[key]}, batch string, _bucket int").parquet(ledger)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            taken = held.where(F.col("_bucket").isin(met) & (F.col("batch") != name)).select(key)
            keyed = keyed.join(taken, key, "left_anti")
        keyed = keyed.persist()
        try:
            fresh = keyed.drop("_bucket").unionByName(rows.where(F.col(key).isNull()))
            (transform(fresh) if transform else fresh).write.mode("overwrite").parquet(f"{sink}/batch={name}")
            keyed.select(key, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{ledger}/batch={name}")
        finally:
            keyed.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, ts: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in tumbling windows, with a watermark for late ones."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window), kind).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), kind, "n", "mean_value")
