"""Entity resolution: names of one type whose Jaro-Winkler similarity reaches a threshold.

Candidates come from a filter that loses no pair. A similarity of at least t needs a Jaro similarity J of at least
(t - 0.1 p) / (1 - 0.1 p), p being the common prefix of up to four characters, and J is at most (m / a + m / b + 1) / 3 for m
matching characters of names of a and b characters. So names must have at least (3 J - 1) a b / (a + b) characters in common,
counted with their repetitions, and two sets that share so many must meet among the first few of their members in any common
order: the rarest first. Each name is sent, for each length that names of its type have, to the keys of those first members;
with the weaker bound where the first characters are equal, with the stronger one where they are not. What meets is counted
again in full and then measured, all in built-in functions.

Names are taken in the order they were first seen: each joins the first earlier canonical name that is similar enough, or
becomes one. A name is decided once all its earlier similar names are, or one of them is canonical; so all names
whose turn does not wait for each other are decided in one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import config
from casewright.functions.normalise import jaro_winkler_column
from casewright.session import written


def _least_jaro(threshold: float, prefix: int) -> float:
    return (threshold - 0.1 * prefix) / (1 - 0.1 * prefix)


def candidate_pairs(names: DataFrame, threshold: float = config.ALIAS_THRESHOLD) -> DataFrame:
    """``entity_type, a, b``, a before b: all pairs of distinct names that can reach the threshold, which is above 0.6."""
    weak, strong = _least_jaro(threshold, 4), _least_jaro(threshold, 0)
    if weak <= 1 / 3:
        raise ValueError("the filter needs a threshold above 0.6")
    one = names.select("entity_type", "name").where("name != ''").distinct().withColumn("n", F.length("name"))
    letters = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substring("name", i, F.lit(1)))
    # a letter with the number of its occurrence in the name
    marked = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    marks = one.withColumn("mark", F.explode(marked))
    often = marks.groupBy("entity_type", "mark").agg(F.count(F.lit(1)).alias("often"))
    held = marks.join(often, ["entity_type", "mark"]).groupBy("entity_type", "name", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "mark"))), lambda x: x["mark"]).alias("marks"))
    held = written(held)
    lengths = held.groupBy("entity_type").agg(F.collect_set("n").alias("lengths"))
    met = held.join(lengths, "entity_type").withColumn("other", F.explode("lengths")).drop("lengths")

    def need(jaro: float, a: Column, b: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.lit(3 * jaro - 1) * a * b / (a + b) - F.lit(1e-9)).cast("int"))

    def keyed(jaro: float, start: Column) -> DataFrame:
        least = need(jaro, F.col("n"), F.col("other"))
        at = met.where(least <= F.least("n", "other"))
        return at.select("entity_type", "name", "n", "marks", F.least("n", "other").alias("lo"), F.greatest("n", "other").alias("hi"), start.alias("start"), F.explode(F.slice("marks", F.lit(1), F.col("n") - least + 1)).alias("mark"))

    keys = keyed(weak, F.substring("name", 1, 1)).unionByName(keyed(strong, F.lit("")))
    on = ["entity_type", "lo", "hi", "start", "mark"]
    side = lambda s: keys.select(*on, F.col("name").alias(s), F.col("n").alias(f"n{s}"), F.col("marks").alias(f"m{s}"))
    both = side("a").join(side("b"), on).where("a < b and na + nb = lo + hi")
    jaro = F.when(F.substring("a", 1, 1) == F.substring("b", 1, 1), F.lit(weak)).otherwise(F.lit(strong))
    enough = F.size(F.array_intersect("ma", "mb")) >= F.greatest(F.lit(1), F.ceil((3 * jaro - 1) * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) - F.lit(1e-9)))
    return both.where(enough).select("entity_type", "a", "b").distinct()


def similar_pairs(names: DataFrame, threshold: float = config.ALIAS_THRESHOLD) -> DataFrame:
    """``entity_type, a, b, score`` for distinct names ``entity_type, name``, a before b."""
    return candidate_pairs(names, threshold).withColumn("score", jaro_winkler_column(F.col("a"), F.col("b"))).where(F.col("score") >= threshold)


def resolve(names: DataFrame, threshold: float = config.ALIAS_THRESHOLD) -> DataFrame:
    """``entity_type, name, canonical_name, score, method`` for ``entity_type, name, seen``; seen orders the names."""
    first = written(names.groupBy("entity_type", "name").agg(F.min("seen").alias("seen")))
    pairs = similar_pairs(first, threshold)
    turn = lambda s: first.select("entity_type", F.col("name").alias(s), F.struct("seen", "name").alias(f"{s}_turn"))
    both = pairs.join(turn("a"), ["entity_type", "a"]).join(turn("b"), ["entity_type", "b"])
    later = F.col("a_turn") > F.col("b_turn")
    pick = lambda x, y: F.when(later, F.col(x)).otherwise(F.col(y))
    earlier = written(both.select("entity_type", pick("a", "b").alias("name"), pick("b", "a").alias("other"), pick("b_turn", "a_turn").alias("turn"), "score"))
    waits = earlier.select("entity_type", "name").distinct()
    status = written(first.select("entity_type", "name").join(waits.withColumn("w", F.lit(True)), ["entity_type", "name"], "left").select("entity_type", "name", F.when(F.col("w"), F.lit(None)).otherwise(F.lit(True)).cast("boolean").alias("canonical")))
    while not status.where("canonical is null").isEmpty():
        known = status.select("entity_type", F.col("name").alias("other"), F.col("canonical").alias("theirs"))
        ahead = earlier.join(known, ["entity_type", "other"]).groupBy("entity_type", "name").agg(F.max(F.col("theirs")).alias("joins"), F.count_if(F.col("theirs").isNull()).alias("open"))
        mine = F.when(F.col("joins"), F.lit(False)).when(F.col("open") == 0, F.lit(True))
        status = written(status.join(ahead, ["entity_type", "name"], "left").select("entity_type", "name", F.coalesce("canonical", mine).alias("canonical")))
    kept = status.where("canonical").select("entity_type", F.col("name").alias("other"))
    joined = earlier.join(status.where("not canonical").select("entity_type", "name"), ["entity_type", "name"], "left_semi").join(kept, ["entity_type", "other"], "left_semi")
    joined = joined.groupBy("entity_type", "name").agg(F.min_by(F.struct("other", "score"), "turn").alias("to"))
    done = joined.select("entity_type", "name", F.col("to.other").alias("canonical_name"), F.col("to.score").alias("score"), F.lit("jaro_winkler").alias("method"))
    return status.where("canonical").select("entity_type", "name", F.col("name").alias("canonical_name"), F.lit(1.0).alias("score"), F.lit("new_entity").alias("method")).unionByName(done)
