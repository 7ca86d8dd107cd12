"""Betweenness as rows of (pivot, node): distances, path counts and dependencies of all pivots at once.

Weights are taken in millionths (at least one), so equal distances are equal numbers. Distances spread from the nodes whose
distance fell in the round before, sixteen pivots to a row, along edges that lie in buckets. On the edges of shortest paths the path counts are summed by number of edges, and the
dependencies the same way backwards: the sum over a path's later nodes is split by the length of the way to them, so no
order of nodes is needed and each round is one join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.operators.edges import adjacency, numbered
from casewright.session import bucketed, cut_lineage, written

UNIT = 1_000_000
#: pivots in a row of distances
SLOTS = 16


def weighted_adjacency(edges: DataFrame) -> DataFrame:
    """``node, neighbour, w``: the lightest edge of each pair, in millionths."""
    units = F.greatest(F.lit(1), F.round(F.col("weight") * UNIT).cast("long"))
    pairs = edges.where("source_entity != target_entity").select(F.least("source_entity", "target_entity").alias("source_entity"), F.greatest("source_entity", "target_entity").alias("target_entity"), units.alias("w"))
    return adjacency(pairs.groupBy("source_entity", "target_entity").agg(F.min("w").alias("w")))


def distances(adj: DataFrame, starts: DataFrame, most_rounds: int = 500, within: int | None = None) -> DataFrame:
    """``pivot, node, d``: the distance of every node that a pivot reaches, ``within`` so much if given. starts: ``pivot, node``."""
    found = frontier = cut_lineage(starts.select("pivot", "node", F.lit(0).cast("long").alias("d")))
    for _ in range(most_rounds):
        step = frontier.join(adj, "node").groupBy("pivot", F.col("neighbour").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        step = step if within is None else step.where(F.col("d") <= within)
        known = found.withColumnRenamed("d", "known")
        frontier = cut_lineage(step.join(known, ["pivot", "node"], "left").where("known is null or d < known").drop("known"))
        if frontier.isEmpty():
            return found
        found = cut_lineage(found.unionByName(frontier).groupBy("pivot", "node").agg(F.min("d").alias("d")))
    raise RuntimeError(f"distances still change after {most_rounds} rounds")


def _rounds(level: DataFrame, step) -> DataFrame:
    """The rows of ``level`` and of all that ``step`` makes of it, again and again until nothing comes."""
    out = level = cut_lineage(level)
    while True:
        level = cut_lineage(step(level))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def _ways(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """``pivot, node, ways``: how many shortest paths lead from the pivot to the node, added up by their number of edges."""
    step = lambda at: at.withColumnRenamed("node", "u").join(steps, ["pivot", "u"]).groupBy("pivot", F.col("v").alias("node")).agg(F.sum("ways").alias("ways"))
    return _rounds(starts.select("pivot", "node", F.lit(1.0).alias("ways")), step).groupBy("pivot", "node").agg(F.sum("ways").alias("ways"))


def _rest(split: DataFrame) -> DataFrame:
    """``pivot, node, rest``: how much of the shortest paths to all later nodes goes through the node."""
    first = split.groupBy("pivot", F.col("u").alias("node")).agg(F.sum("share").alias("rest"))
    step = lambda at: at.withColumnRenamed("node", "v").join(split, ["pivot", "v"]).groupBy("pivot", F.col("u").alias("node")).agg(F.sum(F.col("rest") * F.col("share")).alias("rest"))
    return _rounds(first, step)


def _spread(adj: DataFrame, starts: DataFrame, slots: int, most_rounds: int = 500) -> DataFrame:
    """``part, node, d0, d1, ...``: the distances of a node from the pivots of a part, null where there is no way.

    adj: in buckets of ``node``. starts: ``part, slot, node``. A row holds ``slots`` pivots, and tells only the distances that fell.
    """
    ds = [f"d{i}" for i in range(slots)]
    at = [F.min(F.when(F.col("slot") == i, F.lit(0).cast("long"))).alias(c) for i, c in enumerate(ds)]
    now = written(starts.groupBy("part", "node").agg(*at).withColumn("fell", F.lit((1 << slots) - 1).cast("long")))
    for _ in range(most_rounds):
        new = now.where("fell != 0").select("part", "node", *[F.when(F.col("fell").bitwiseAND(F.lit(1 << i)) != 0, F.col(c)).alias(c) for i, c in enumerate(ds)])
        step = new.join(adj, "node").groupBy("part", F.col("neighbour").alias("node")).agg(*[F.min(F.col(c) + F.col("w")).alias(f"s{i}") for i, c in enumerate(ds)])
        both = now.drop("fell").join(step, ["part", "node"], "full")
        falls = [F.when(F.col(f"s{i}").isNotNull() & (F.col(c).isNull() | (F.col(f"s{i}") < F.col(c))), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(ds)]
        now = written(both.select("part", "node", *[F.least(c, f"s{i}").alias(c) for i, c in enumerate(ds)], reduce(lambda a, b: a + b, falls).alias("fell")))
        if now.where("fell != 0").isEmpty():
            return now.drop("fell")
    raise RuntimeError(f"distances still change after {most_rounds} rounds")


def _tight(pairs: DataFrame, far: DataFrame, slots: int) -> DataFrame:
    """``part, slot, u, v``: the edges of shortest paths, in their direction. pairs: ``a, b, w`` in buckets of ``a``, each once."""
    ds = [f"d{i}" for i in range(slots)]
    of = lambda side: far.select("part", F.col("node").alias(side), *[F.col(c).alias(f"{side}{c}") for c in ds])
    met = of("a").join(pairs, "a").join(of("b"), ["part", "b"])
    way = [F.when(F.col(f"a{c}") + F.col("w") == F.col(f"b{c}"), 1).when(F.col(f"b{c}") + F.col("w") == F.col(f"a{c}"), -1).otherwise(0) for c in ds]
    hit = met.select("part", "a", "b", F.posexplode(F.array(*way)).alias("slot", "way")).where("way != 0")
    return hit.select("part", "slot", F.when(F.col("way") > 0, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(F.col("way") > 0, F.col("b")).otherwise(F.col("a")).alias("v"))


def betweenness(edges: DataFrame, pivots: int = 200, seed: int = 17) -> DataFrame:
    """``node, betweenness``: weighted, normalised; exact up to ``pivots`` nodes, else from that many seeded pivots."""
    units = F.greatest(F.lit(1), F.round(F.col("weight") * UNIT).cast("long"))
    ids, e = numbered(edges.where("source_entity != target_entity").select("source_entity", "target_entity", units.alias("w")))
    e = e.groupBy(F.least("source_entity", "target_entity").alias("a"), F.greatest("source_entity", "target_entity").alias("b")).agg(F.min("w").alias("w"))
    pairs = bucketed(e, "a")
    adj = bucketed(adjacency(pairs.select(F.col("a").alias("source_entity"), F.col("b").alias("target_entity"), "w")), "node")
    nodes = ids.select(F.col("id").alias("node"), "name")
    n = nodes.count()
    chosen = nodes if n <= pivots else nodes.orderBy(F.xxhash64("name", F.lit(seed)), "name").limit(pivots)
    # at most ``pivots`` rows
    place = F.row_number().over(Window.orderBy("node")) - 1
    starts = written(chosen.select("node", place.alias("place")).select(F.col("node").alias("pivot"), "node", (F.col("place") / SLOTS).cast("int").alias("part"), (F.col("place") % SLOTS).alias("slot")))
    far = _spread(adj, starts, SLOTS)
    steps = _tight(pairs, far, SLOTS).join(F.broadcast(starts.select("part", "slot", "pivot")), ["part", "slot"])
    steps = written(steps.select("pivot", "u", "v"))
    ways = written(_ways(steps, starts))
    of = lambda side: ways.select("pivot", F.col("node").alias(side), F.col("ways").alias(f"{side}_ways"))
    split = written(steps.join(of("u"), ["pivot", "u"]).join(of("v"), ["pivot", "v"]).select("pivot", "u", "v", (F.col("u_ways") / F.col("v_ways")).alias("share")))
    rest = _rest(split)
    scale = (n / min(n, pivots)) / max(1, (n - 1) * (n - 2)) if n else 0.0
    got = rest.where("node != pivot").groupBy("node").agg(F.sum("rest").alias("v"))
    return nodes.join(got, "node", "left").select(F.col("name").alias("node"), F.round(F.coalesce("v", F.lit(0.0)) * F.lit(scale), 6).alias("betweenness"))
