"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are looked for inside documents of any length. Items are partitioned by the number of their
distinct shingles; in a partition with sizes from ``lo`` to below ``hi`` every item is represented by its MinHash
bottom-k sketch with ``k = size - ceil(threshold * size) + 1`` values for its size. A document that contains at
least ``threshold`` of the item's shingles lacks at most ``k - 1`` of them, so it holds one sketch value at least:
the sketch finds every such pair. Only sketches are probed with the documents' shingles, and what they hit are
candidate pairs. Documents with candidates are read again, and a candidate is verified by the exact number of the
item's shingles in the document.

A shingle is five consecutive lower-cased words (A-Z), held as a 64-bit hash. Items and documents with fewer
words, and null and empty texts, have no shingles and match nothing. Rows of one id with different texts are items
(documents) of their own, each judged by its own text; repeated rows of one id and text give one row. A null doc_id
or item_id is an id like any other in ``contaminated``; ``remove_contaminated`` keeps documents without id.
Extra columns are ignored; empty tables give an empty table.

Sketches, the candidates' shingles and the candidates are broadcast only after a count shows at most
``broadcast_rows`` rows; larger ones go through shuffled joins, where AQE splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm import textsql
from casewright.llm.shared import broadcast_checked, cut


def shingled(docs: DataFrame, key: str, text: str, name: str, n: int) -> DataFrame:
    """``name, _key, _sh``: the shingle hashes of each text, with repeats; ``_key`` names a row by id and text."""
    low = textsql.ascii_lower(F.coalesce(F.col("_t"), F.lit("")))
    named = docs.select(F.col(key).alias(name), F.col(text).cast("string").alias("_t"))
    return named.select(name, F.xxhash64(name, "_t").alias("_key"), textsql.words(low).alias("_w")).select(name, "_key", textsql.windows(F.col("_w"), n).alias("_sh"))


def item_index(items: DataFrame, key: str = "item_id", text: str = "text", n: int = 5, threshold: float = 0.75, bands: tuple[int, ...] = (8, 16, 32, 64, 128, 256)) -> DataFrame:
    """``item_id, item, shingle, n_item, band, least, in_sketch``: every item's distinct shingles, the sketch marked."""
    flat = shingled(items, key, text, "item_id", n).select("item_id", F.col("_key").alias("item"), F.explode("_sh").alias("shingle")).distinct()
    per_item = Window.partitionBy("item")
    rank = F.row_number().over(per_item.orderBy(F.xxhash64("shingle"), "shingle"))
    size = F.count(F.lit(1)).over(per_item)
    least = F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    band = F.lit(0)
    for k, lo in enumerate(bands, 1):
        band = F.when(F.col("n_item") >= lo, F.lit(k)).otherwise(band)
    return flat.withColumn("rank", rank).withColumn("n_item", size.cast("int")).withColumn("least", least).withColumn("band", band).withColumn("in_sketch", F.col("rank") <= F.col("n_item") - F.col("least") + 1).drop("rank")


def candidates(held: DataFrame, index: DataFrame, broadcast_rows: int) -> DataFrame:
    """``_key, item`` for each document of ``shingled`` that holds a sketch value of an item of a fitting size partition."""
    least_of_band = index.groupBy("band").agg(F.min("least").alias("band_least"))
    sketch = index.where("in_sketch").select("item", "shingle", "band").join(F.broadcast(least_of_band), "band").select("item", "shingle", "band_least")
    sketch = broadcast_checked(sketch, broadcast_rows)
    # the outer form keeps Spark from testing each array for rows in a filter that would compute it twice
    probes = held.select("_key", F.size("_sh").alias("n_doc"), F.explode_outer("_sh").alias("shingle"))
    # a document with fewer shingles than a size partition needs is not probed against it
    hits = probes.join(sketch, (probes["shingle"] == sketch["shingle"]) & (probes["n_doc"] >= sketch["band_least"]))
    return hits.select("_key", "item").distinct()


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", n: int = 5, threshold: float = 0.75, broadcast_rows: int = 500_000) -> DataFrame:
    """``item_id, doc_id, n_item, n_shared, containment`` for each pair with at least ``threshold`` containment."""
    index = cut(item_index(items, item_id, text, n, threshold))
    found = cut(candidates(shingled(docs, doc_id, text, "doc_id", n), index, broadcast_rows))
    # the candidates' documents again, each once, and only their candidates' shingles
    asked = broadcast_checked(found.select("_key").distinct(), broadcast_rows)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    again = own.join(asked, F.xxhash64(own["doc_id"], own["text"]) == asked["_key"], "left_semi")
    held = shingled(again, "doc_id", "text", "doc_id", n).select("doc_id", "_key", F.explode_outer("_sh").alias("shingle"))
    wanted = broadcast_checked(index.select("item_id", "item", "shingle", "n_item", "least").join(found.select("item").distinct(), "item", "left_semi"), broadcast_rows)
    hits = held.join(wanted, "shingle").groupBy("_key", "item", "doc_id", "item_id", "n_item", "least").agg(F.count_distinct("shingle").alias("n_shared"))
    kept = hits.join(found, ["_key", "item"], "left_semi").where(F.col("n_shared") >= F.col("least"))
    return kept.select("item_id", "doc_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"), F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that contain no item, with all their columns. Documents with a null id are kept.

    Rows of one doc_id go together, where one of them contains an item.
    """
    found = contaminated(docs, items, doc_id=doc_id, text=text, **options).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(found, docs[doc_id] == found["_found"], "left_anti")
