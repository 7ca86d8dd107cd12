"""The k lightest simple paths between two entities over the whole graph, with the edges walked.

The paths of at most three edges say how heavy a path of the answer can be. Then the least weight from every node to the target
spreads backwards through the graph, as far as that: a bound that never promises too much. Then partial paths are extended best-first by weight so far plus bound, a batch a round; a partial path goes where
that sum passes the k-th path found, and the search ends when no partial path can be lighter than it. Weights are taken in
millionths, so ties are ties: they fall in the order of the paths' nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.operators.brokers import distances, weighted_adjacency
from casewright.session import cut_lineage


def short_path_bound(adj: DataFrame, source: str, target: str, k: int, cutoff: int | None = None, most_sent: int = 500_000) -> int | None:
    """A weight that no path of the answer exceeds, None where none is known: that of the ``k``-th lightest simple path of at most three edges.

    Where there are fewer than ``k`` of these, a longer path may be in the answer, unless a ``cutoff`` of three or less ends the list
    before it: then none is heavier than the last of them, and without one there is no answer (-1). adj: ``node, neighbour, w``.
    """
    most = 3 if cutoff is None else min(3, cutoff)
    ends = [adj.where((F.col(x) == at) & (F.col(y) != other)).select(F.col(y).alias(name), F.col("w").alias(f"{name}_w")) for x, y, at, other, name in (("node", "neighbour", source, target, "a"), ("neighbour", "node", target, source, "b"))]
    one = adj.where((F.col("node") == source) & (F.col("neighbour") == target)).select("w")
    near = [cut_lineage(e) for e in ends]
    sent = [F.broadcast(e) if e.count() <= most_sent else e for e in near]
    two = near[0].join(sent[1].withColumnRenamed("b", "a"), "a").select((F.col("a_w") + F.col("b_w")).alias("w"))
    three = adj.select(F.col("node").alias("a"), F.col("neighbour").alias("b"), "w").join(sent[0], "a").join(sent[1], "b").select((F.col("a_w") + F.col("w") + F.col("b_w")).alias("w"))
    ways = one
    for at, more in ((2, two), (3, three)):
        ways = ways.unionByName(more) if at <= most else ways
    got = ways.where(F.lit(most > 0)).orderBy("w").limit(k).agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w")).first()
    if got.n == k or (got.n and cutoff is not None and cutoff <= 3):
        return got.w
    return -1 if cutoff is not None and cutoff <= 3 else None


def k_shortest(edges: DataFrame, source: str, target: str, k: int = 1, cutoff: int | None = None, batch: int = 1000, most_rounds: int = 1000, within: int | None = None) -> DataFrame:
    """``path_rank, path`` of at most ``k`` simple paths, lightest first.

    With a ``cutoff`` the list ends before the first path of more edges, even where a heavier one would be short enough.
    ``within``: paths heavier than so many millionths do not count, and nodes farther from the target are not visited. Nor are paths
    followed that are heavier than ``short_path_bound``.
    """
    spark = edges.sparkSession
    none = spark.createDataFrame([], "path_rank int, path array<string>")
    if not source or not target or source == target:
        return none
    adj = cut_lineage(weighted_adjacency(edges))
    bound = short_path_bound(adj, source, target, max(1, k), cutoff)
    within = min((x for x in (bound, within) if x is not None), default=None)
    if within is not None and within < 0:
        return none
    bound = cut_lineage(distances(adj, spark.createDataFrame([(target, target)], "pivot string, node string"), within=within).select(F.col("node").alias("neighbour"), F.col("d").alias("rest")))
    start = bound.where(F.col("neighbour") == source)
    going = cut_lineage(start.select(F.col("neighbour").alias("node"), F.array("neighbour").alias("path"), F.lit(0).cast("long").alias("g"), F.col("rest").alias("f")))
    done, most = None, max(1, k)
    for _ in range(most_rounds):
        best = cut_lineage(going.orderBy("f", "path").limit(batch))
        step = F.broadcast(best.select("node", "path", "g")).join(adj, "node").where(~F.array_contains("path", F.col("neighbour"))).join(bound, "neighbour")
        step = step.select(F.col("neighbour").alias("node"), F.array_append("path", F.col("neighbour")).alias("path"), (F.col("g") + F.col("w")).alias("g"), (F.col("g") + F.col("w") + F.col("rest")).alias("f"))
        step = cut_lineage(step if within is None else step.where(F.col("f") <= within))
        reached = step.where(F.col("node") == target)
        # of the complete paths never more than the k lightest are kept
        done = cut_lineage((reached if done is None else done.unionByName(reached)).orderBy("g", "path").limit(most))
        full = done.agg(F.count(F.lit(1)).alias("n"), F.max("g").alias("g")).first()
        going = going.join(best.select("path"), "path", "left_anti").select("node", "path", "g", "f").unionByName(step.where(F.col("node") != target))
        going = cut_lineage(going.where(F.col("f") <= full.g) if full.n == most else going)
        if going.isEmpty():
            break
    else:
        raise RuntimeError(f"paths are not settled after {most_rounds} rounds")
    # at most k rows
    ranked = done.withColumn("path_rank", F.row_number().over(Window.orderBy("g", "path")))
    if cutoff is not None:
        over = ranked.where(F.size("path") - 1 > cutoff).agg(F.min("path_rank").alias("first_over"))
        ranked = ranked.crossJoin(over).where("first_over is null or path_rank < first_over")
    return ranked.select("path_rank", "path")


def _places(x: Column, n: int) -> Column:
    """A positive number to ``n`` places, halves of the binary value upwards as SQL engines do; ``F.round`` goes by the decimal form."""
    return F.floor(x * 10**n + 0.5) / 10**n


def hydrate(paths: DataFrame, view: DataFrame) -> DataFrame:
    """One row a hop: ``path_rank, hop, node, next_node, rel_id, relation_type, direction, confidence, evidence_count, weight,
    total_weight, min_confidence, hops``.

    view: all parallel edges with their measures; a hop takes the lightest in either direction, a forward one in a tie, then
    by rel_id. paths: few, so their hops are sent to the edges.
    """
    hops = paths.select("path_rank", "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("hop"))
    hops = hops.select("path_rank", "hop", (F.size("path") - 1).alias("hops"), F.get("path", F.col("hop") - 1).alias("node"), F.get("path", F.col("hop")).alias("next_node"))
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    sides = F.broadcast(hops.select("*", *pair("node", "next_node")))
    edge = view.select(*pair("source_entity", "target_entity"), "source_entity", "rel_id", "relation_type", "confidence", "evidence_count", "weight")
    found = edge.join(sides, ["a", "b"]).withColumn("direction", F.when(F.col("source_entity") == F.col("node"), "forward").otherwise("reverse"))
    order = Window.partitionBy("path_rank", "hop").orderBy("weight", "direction", "rel_id")
    found = found.withColumn("r", F.row_number().over(order)).where("r = 1")
    whole = Window.partitionBy("path_rank")
    found = found.withColumns({"total_weight": _places(F.sum("weight").over(whole), 4), "min_confidence": F.round(F.min("confidence").over(whole), 4)})
    return found.select("path_rank", "hop", "node", "next_node", "rel_id", "relation_type", "direction", "confidence", "evidence_count", "weight", "total_weight", "min_confidence", "hops")


def cited(hops: DataFrame, citations: DataFrame) -> DataFrame:
    """Each hop with its ``citations`` (``evidence_id, doc_id, page, span_text``), an empty list where there are none."""
    wanted = citations.join(F.broadcast(hops.select("rel_id").distinct()), "rel_id", "left_semi")
    held = wanted.groupBy("rel_id").agg(F.sort_array(F.collect_list(F.struct("page", "evidence_id", "doc_id", "span_text"))).alias("citations"))
    return hops.join(held, "rel_id", "left").withColumn("citations", F.coalesce("citations", F.array()))
