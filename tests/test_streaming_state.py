"""Streams in several batches: a ledger of keys, keyed names, progress rows."""

import random
import time

from pyspark.sql import functions as F

from casewright.operators import resolve
from casewright.streaming import ingest, progress, state


def put(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{number}")


def run(query):
    query.awaitTermination(90)
    assert query.exception() is None


def test_ledger(spark, tmp_path):
    folder, sink, check = (str(tmp_path / n) for n in ("in", "sink", "check"))
    schema = "source_hash string, n int"
    source = lambda: ingest.read_documents(spark, folder + "/*", schema, files_per_batch=1)
    put(spark, folder, 0, [("a", 1), ("b", 2), ("a", 3), (None, 9)], schema)
    put(spark, folder, 1, [("b", 4), ("c", 5), (None, 10)], schema)
    run(ingest.ingest_new(source(), sink, check, buckets=4))
    held = lambda: sorted((r.source_hash or "", r.n) for r in spark.read.parquet(sink).collect())
    assert [k for k, _ in held()] == ["", "", "a", "b", "c"]
    run(ingest.ingest_new(source(), sink, check, buckets=4))
    assert len(held()) == 5
    put(spark, folder, 2, [("a", 6), ("d", 7)], schema)
    run(ingest.ingest_new(source(), sink, check, buckets=4))
    assert [k for k, _ in held()] == ["", "", "a", "b", "c", "d"]
    # a lost checkpoint: everything comes again, and only rows without a key are taken twice
    run(ingest.ingest_new(source(), sink, check + "2", buckets=4))
    assert sorted(k for k, _ in held() if k) == ["a", "b", "c", "d"]


def test_names_in_batches_equal_one_batch(spark, tmp_path):
    rnd = random.Random(4)
    base = ["Marcus Webb", "Anna Hart", "Annette Hartley", "Zed", "zoe"]
    rows = []
    for k in range(90):
        w = list(rnd.choice(base))
        if rnd.random() < 0.7:
            w[rnd.randrange(1, len(w))] = rnd.choice("abx")
        rows.append((rnd.choice(["PERSON", "ALIAS"]), "".join(w), k))
    folder, schema = str(tmp_path / "in"), "entity_type string, name string, seen int"
    for i in range(3):
        put(spark, folder, i, rows[30 * i : 30 * i + 30], schema)
        time.sleep(1.1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    events = str(tmp_path / "events")
    listener = progress.ProgressRows(spark, events, names=("names",))
    spark.streams.addListener(listener)
    try:
        stream = state.resolve_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/*"))
        run(stream.writeStream.queryName("names").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        time.sleep(2)
        spark.streams.removeListener(listener)
    got = {(r.entity_type, r.name): r.canonical_name for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    blocks = spark.createDataFrame(rows, schema).withColumn("entity_type", F.concat_ws("/", "entity_type", state.block(F.col("name"))))
    want = {(r.entity_type.split("/")[0], r.name): r.canonical_name for r in resolve.resolve(blocks).collect()}
    assert got == want
    told = spark.read.schema(progress.EVENT).parquet(events).orderBy("started_at").collect()
    assert [r["rows"] for r in told] == [30, 30, 30] and {r.status for r in told} == {"success"} and len({r.event_id for r in told}) == 3
