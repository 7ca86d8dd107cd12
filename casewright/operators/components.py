"""Connected components by large-star and small-star rounds, whose number grows with the logarithm of a path's length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.session import cut_lineage


def stars(links: DataFrame, most_rounds: int) -> DataFrame:
    """``a, b``: each node that reaches a smaller one, with the smallest that it reaches.

    links: distinct ``a, b`` with a over b. An error if the rounds do not end; never a part of the answer.
    """
    e, before = links, None
    for _ in range(most_rounds):
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        down = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        e = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        e = cut_lineage(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e
        before = now
    raise RuntimeError(f"components still change after {most_rounds} rounds")
