"""Walks over the graph: neighbours, two-stage expansion, k hops, bounded simple paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.operators.edges import adjacency
from casewright.session import cut_lineage, written


def one_hop(edges: DataFrame, seeds: list[str]) -> DataFrame:
    """Edges that touch a seed."""
    return edges.where(F.col("source_entity").isin(seeds) | F.col("target_entity").isin(seeds))


def two_stage(edges: DataFrame, seeds: list[str], limit: int) -> DataFrame:
    """The seeds' best edges, then the best edges of the neighbours these found; an edge keeps its later hop.

    edges: with ``rel_id, confidence``; each stage takes ``limit`` edges by confidence, then rel_id.
    """
    order = [F.desc("confidence"), F.asc("rel_id")]
    first = cut_lineage(one_hop(edges, seeds).orderBy(*order).limit(limit))
    # at most two nodes for each of ``limit`` edges, so a list: a filter goes below every join that made the edges
    ends = [r.node for r in first.select(F.explode(F.array("source_entity", "target_entity")).alias("node")).distinct().where(F.col("node").isNotNull() & ~F.col("node").isin(seeds)).collect()]
    second = one_hop(edges, ends).orderBy(*order).limit(limit)
    both = first.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("rel_id").orderBy(F.desc("hop")))).where("r = 1").drop("r").orderBy(*order).limit(2 * limit)


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``node, depth``: all nodes within ``hops`` of the seeds. A level is one join; visited nodes are not entered again."""
    adj = cut_lineage(adjacency(edges.select("source_entity", "target_entity")).distinct())
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, hops + 1):
        found = frontier.select("node").join(adj, "node").select(F.col("neighbour").alias("node")).distinct()
        frontier = cut_lineage(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are both among ``nodes``."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "source_entity"), "source_entity", "left_semi").join(n.withColumnRenamed("node", "target_entity"), "target_entity", "left_semi")


def simple_paths(edges: DataFrame, source: str, target: str, cutoff: int, k: int) -> DataFrame:
    """The ``k`` cheapest simple paths of at most ``cutoff`` edges: ``path, weight, hops``.

    edges: one row for each pair, with ``weight``. Paths that came back, or reached the target, are not carried on.
    """
    adj = cut_lineage(adjacency(edges.select("source_entity", "target_entity", "weight")))
    spark = edges.sparkSession
    going = spark.createDataFrame([(source, [source], 0.0)], "node string, path array<string>, weight double")
    done = None
    for _ in range(cutoff):
        step = going.alias("g").join(adj.alias("a"), F.col("g.node") == F.col("a.node")).where(~F.array_contains("g.path", F.col("a.neighbour")))
        step = step.select(F.col("a.neighbour").alias("node"), F.array_append("g.path", F.col("a.neighbour")).alias("path"), (F.col("g.weight") + F.col("a.weight")).alias("weight"))
        step = cut_lineage(step)
        reached = step.where(F.col("node") == target)
        done = reached if done is None else done.unionByName(reached)
        going = step.where(F.col("node") != target)
    out = done.select(F.array_join("path", ">").alias("path"), F.round("weight", 6).alias("weight"), (F.size("path") - 1).alias("hops"))
    return out.orderBy("weight", "path").limit(k)


def resolve_entity(entities: DataFrame, aliases: DataFrame | None, name: str) -> DataFrame:
    """The entity whose id, name or alias is ``name`` (names in any case): id first, then the most mentions."""
    low = name.strip().lower()
    hit = F.when(F.col("entity_id") == name, 0).when(F.lower("canonical_name") == low, 1)
    found = entities.withColumn("how", hit)
    if aliases is not None:
        of_alias = aliases.where(F.lower("alias_text") == low).select("entity_id").distinct().withColumn("by_alias", F.lit(2))
        found = found.join(of_alias, "entity_id", "left").withColumn("how", F.coalesce("how", "by_alias")).drop("by_alias")
    order = [F.expr("how != 0"), F.desc("mention_count"), "entity_id"] if "mention_count" in entities.columns else ["how", "entity_id"]
    return found.where("how is not null").orderBy(*order).limit(1).drop("how")


def evidence_paths(edges: DataFrame, source: str, target: str, hops: int = 3, most: int = 5, most_sent: int = 100_000) -> DataFrame:
    """The first ``most`` paths of a breadth-first walk: ``path, rel_ids, hops``.

    A node is entered once, by its first edge in the order of the walk (parents in order, then confidence, then
    rel_id); the target is never entered, so every edge that reaches it ends a path. Paths of fewer hops come first, so the walk
    ends with the level that has ``most``. The edges are written once, and stay where they are while a level is at most
    ``most_sent`` nodes.
    """
    adj = adjacency(written(edges.select("rel_id", "source_entity", "target_entity", "confidence")))
    spark, last = edges.sparkSession, max(1, min(hops, 4))
    level = spark.createDataFrame([(source, 1, [source], [])], "node string, place long, path array<string>, rels array<string>")
    seen, done = level.select("node"), None
    for depth in range(1, last + 1):
        sent = F.broadcast(level) if level.count() <= most_sent else level
        # the last level asks for the target alone
        near = adj if depth < last else adj.where(F.col("neighbour") == target)
        step = near.join(sent, "node").select("place", "confidence", "rel_id", F.col("neighbour").alias("node"), F.array_append("path", F.col("neighbour")).alias("path"), F.array_append("rels", F.col("rel_id")).alias("rels"))
        hit = cut_lineage(step.where(F.col("node") == target).withColumn("depth", F.lit(depth)))
        done = hit if done is None else done.unionByName(hit)
        if depth == last or done.count() >= most:
            break
        new = step.where(F.col("node") != target).join(seen, "node", "left_anti")
        one = new.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("place", F.desc("confidence"), "rel_id"))).where("r = 1")
        # after a distributed sort these ids grow in its order, which is all that a level's order is needed for
        level = cut_lineage(one.orderBy("place", F.desc("confidence"), "rel_id").select("node", F.monotonically_increasing_id().alias("place"), "path", "rels"))
        seen = seen.unionByName(level.select("node"))
    return done.orderBy("depth", "place", F.desc("confidence"), "rel_id").limit(most).select(F.array_join("path", ">").alias("path"), F.array_join("rels", ",").alias("rel_ids"), F.col("depth").alias("hops"))


def neighbours(edges: DataFrame, seed: str, depth: int = 1, limit: int = 25) -> DataFrame:
    """The seed's best edges; with depth 2 also its neighbours' best edges that do not touch the seed, ``limit`` in all."""
    order = [F.desc("confidence"), F.asc("rel_id")]
    first = one_hop(edges, [seed]).orderBy(*order).limit(limit).withColumn("hop", F.lit(1))
    if depth < 2:
        return first
    ends = first.select(F.explode(F.array("source_entity", "target_entity")).alias("node")).distinct().where(F.col("node") != seed)
    away = edges.where((F.col("source_entity") != seed) & (F.col("target_entity") != seed))
    ids = adjacency(away).join(F.broadcast(ends), "node", "left_semi").select("rel_id").distinct()
    second = away.join(ids, "rel_id", "left_semi").orderBy(*order).limit(limit).withColumn("hop", F.lit(2))
    return first.unionByName(second).orderBy("hop", *order).limit(limit)
