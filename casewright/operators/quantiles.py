"""Exact order statistics of groups by narrowing ranges, without sorting a group in one task.

Each wanted rank of a group has a range of values that holds it. A round counts the range's values in equal parts, with
partial counts before the shuffle, and opens only the part that the rank falls in, tightened to the least and greatest value
there; it ends when these are equal. A group of any size, or of one value, costs a few counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.session import written


def at_ranks(values: DataFrame, by: list[str], value: str, ranks: DataFrame, parts: int = 256, most_rounds: int = 200) -> DataFrame:
    """``by, rank, value``: the value at each rank (from 0) of its group. ranks: ``by, rank``. Null values do not count."""
    held = values.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ends = held.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    # a rank past the group's end has no value
    open_ = written(ranks.select(*by, "rank").distinct().join(ends, by).where("rank >= 0 and rank < _n").select(*by, "rank", "_lo", "_hi", F.lit(0).cast("long").alias("_below")))
    done = []
    for _ in range(most_rounds):
        done.append(open_.where("_lo = _hi").select(*by, "rank", F.col("_lo").alias(value)))
        ranges = open_.where("_lo < _hi")
        if ranges.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out
        # halves are subtracted so that a range of nearly all doubles does not overflow
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        part = F.least(F.lit(parts - 1), F.floor(share * parts).cast("int"))
        counts = held.join(ranges, by).where("_v between _lo and _hi").groupBy(*by, "rank", "_below", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.sum("_n").over(Window.partitionBy(*by, "rank").orderBy("_part")) - F.col("_n") + F.col("_below")
        counts = counts.withColumn("_before", before).where("rank >= _before and rank < _before + _n")
        open_ = written(counts.select(*by, "rank", "_lo", "_hi", F.col("_before").alias("_below")))
    raise RuntimeError(f"ranges are still open after {most_rounds} rounds")


def percentiles(values: DataFrame, by: list[str], value: str, shares: dict[str, float], nearest: tuple[str, ...] = ()) -> DataFrame:
    """``by`` and a column for each of ``shares``: between the two ranks beside (n - 1) * share, or the nearest one for names in ``nearest``."""
    n = values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    spot = lambda name: (F.col("_n") - 1) * F.lit(shares[name])
    low = lambda name: F.floor(spot(name) + (0.5 if name in nearest else 0.0)).cast("long")
    high = lambda name: low(name) if name in nearest else F.ceil(spot(name)).cast("long")
    wanted = n.select(*by, F.explode(F.array_distinct(F.array(*[f(name) for name in shares for f in (low, high)]))).alias("rank"))
    found = at_ranks(values, by, value, wanted).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("_at"))

    def of(name: str):
        a, b = F.element_at("_at", low(name)), F.element_at("_at", high(name))
        return (a + (b - a) * (spot(name) - low(name)) if name not in nearest else a).alias(name)

    return n.join(found, by).select(*by, *[of(name) for name in shares])
