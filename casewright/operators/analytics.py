"""Graph measures: degree, PageRank, components, label propagation, modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.operators.components import stars
from casewright.operators.edges import adjacency, numbered
from casewright.session import bucketed, cut_lineage, written


def degree_centrality(edges: DataFrame) -> DataFrame:
    """``node, degree, centrality``: distinct neighbours, and their share of all other nodes."""
    per = adjacency(edges.select("source_entity", "target_entity")).where("node != neighbour").groupBy("node").agg(F.count_distinct("neighbour").alias("degree"))
    n = per.agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(n)).select("node", "degree", F.round(F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("centrality"))


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85, mode: str = "cost", cut_every: int = 5) -> DataFrame:
    """``node, rank`` after a fixed number of rounds on the undirected graph; every node has an edge.

    ``mode``: "cost" moves mass in proportion to the weight column as it stands, "affinity" to its inverse.
    edges: one row for each pair with ``weight``.
    """
    share = F.col("weight") if mode == "cost" else 1 / F.col("weight")
    ids, e = numbered(edges.select("source_entity", "target_entity", share.alias("w")))
    adj = adjacency(e)
    total = adj.groupBy("node").agg(F.sum("w").alias("t"))
    step = bucketed(adj.join(total, "node").select("node", "neighbour", (F.col("w") / F.col("t")).alias("p")), "node")
    n = ids.count()
    rank = ids.select(F.col("id").alias("node"), F.lit(1 / n if n else None).cast("double").alias("rank"))
    for k in range(rounds):
        moved = rank.join(step, "node").groupBy(F.col("neighbour").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("rank"))
        rank = moved.select("node", (F.lit((1 - damping) / n if n else None).cast("double") + damping * F.col("rank")).alias("rank"))
        if (k + 1) % cut_every == 0:
            rank = cut_lineage(rank)
    return rank.join(ids, rank["node"] == ids["id"]).select(F.col("name").alias("node"), "rank")


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node, component``: the smallest node that can be reached; an error if ``most_rounds`` do not settle it.

    edges may be there more than once. One with a missing end is a loop at the other. Before the rounds the targets of a source are
    linked with the smallest of them, as the source is: the same components, and where sources share targets far fewer links.
    """
    ends = edges.select(F.coalesce("source_entity", "target_entity").alias("s"), F.coalesce("target_entity", "source_entity").alias("t"))
    # the edge to the smallest target stays with its source, each other one goes from its target
    ends = ends.withColumn("m", F.min("t").over(Window.partitionBy("s"))).select(F.when(F.col("t") == F.col("m"), F.col("s")).otherwise(F.col("t")).alias("x"), "m")
    held = cut_lineage(ends.select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct())
    found = stars(held.where("a != b"), most_rounds).select(F.col("a").alias("node"), F.col("b").alias("component"))
    nodes = held.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``node, community``: every node takes the label of most weight among its neighbours, the smallest in a tie.

    Nodes take turns by the parity of their hash, so that two halves cannot swap labels for ever.
    """
    ids, e = numbered(edges.select("source_entity", "target_entity", "weight"))
    turn = F.pmod(F.xxhash64("name"), F.lit(2))
    adj = adjacency(e).where("node != neighbour")
    # a round hears only those whose turn it is
    heard = adj.join(ids.select(F.col("id").alias("node"), turn.alias("turn")), "node")
    halves = [bucketed(heard.where(F.col("turn") == k).drop("turn"), "neighbour") for k in (0, 1)]
    # a node with a loop alone has no neighbour
    label = written(adj.select("node").distinct().withColumn("community", F.col("node")))
    for k in range(rounds):
        votes = label.withColumnRenamed("node", "neighbour").join(halves[k % 2], "neighbour").repartition("node").groupBy("node", "community").agg(F.round(F.sum("weight"), 9).alias("w"))
        won = votes.groupBy("node").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("won"))
        label = written(label.join(won, "node", "left").select("node", F.coalesce("won", "community").alias("community")))
    named = lambda c: ids.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    return label.join(named("node"), "node").join(named("community"), "community").select(F.col("node_name").alias("node"), F.col("community_name").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: ``modularity``, rounded to 4 places."""
    of = lambda side: communities.select(F.col("node").alias(f"{side}_entity"), F.col("community").alias(f"{side}_c"))
    e = edges.select("source_entity", "target_entity", "weight").join(of("source"), "source_entity").join(of("target"), "target_entity")
    inside = F.when(F.col("source_c") == F.col("target_c"), F.col("weight")).otherwise(F.lit(0.0))
    ends = e.select("weight", F.explode(F.array(F.struct(F.col("source_c").alias("c"), inside.alias("inside")), F.struct(F.col("target_c").alias("c"), F.lit(0.0).alias("inside")))).alias("end"))
    # one pass over the edges; every edge counts in two degrees
    per = written(ends.groupBy("end.c").agg(F.sum("weight").alias("degree"), F.sum("end.inside").alias("inside")))
    m = per.agg((F.sum("degree") / 2).alias("m"))
    return per.crossJoin(F.broadcast(m)).agg(F.round(F.sum(F.col("inside") / F.col("m") - resolution * F.pow(F.col("degree") / (2 * F.col("m")), 2)), 4).alias("modularity"))
