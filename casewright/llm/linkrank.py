"""URL filters: rules by host and path, and link-graph propagation for the urls that no rule fits.

Trust flows from trusted seed hosts along host edges, distrust from blocked seed hosts against them, both as
personalised PageRank with ``damping`` over ``rounds`` rounds of a join and a sum. A host whose share of distrust
in its trust plus distrust is above ``threshold`` is blocked, any other host is allowed.

Host edges are the absolute links of the pages' html to other hosts, and an edge each way between a host and its
parent domain where that has three labels at least. A host's seed weight is the number of its pages that an allow
(block) rule fits.

A null url, or one without ``://``, has an empty host and path; no rule fits it and it is allowed. A null html has
no links. Repeated pages count as often as they occur. A hot host's pages are summed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm import textsql
from casewright.llm.shared import cut

LINK = r"(?i)\bhref\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), textsql.UPPER, textsql.LOWER)
    return F.when(F.instr(url, "://") > 0, found).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does. rules: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst, n``: links between different hosts, counted."""
    own = pages.select(host_of(F.col(url)).alias("src"), F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)).alias("links")).where(F.size("links") > 0)
    linked = own.select("src", F.explode("links").alias("dst")).withColumn("dst", F.translate("dst", textsql.UPPER, textsql.LOWER)).where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    hosts = pages.select(host_of(F.col(url)).alias("src")).where(F.col("src") != "").distinct().unionByName(linked.select(F.col("dst").alias("src"))).distinct()
    parent = hosts.where(F.size(F.split("src", r"\.")) >= 4).select("src", F.regexp_extract("src", r"^[^.]*\.(.*)$", 1).alias("dst"))
    both = parent.unionByName(parent.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1).cast("long"))
    return linked.unionByName(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 12, cut_every: int = 4) -> DataFrame:
    """``kind, host, score``. edges: ``kind, src, dst, n``; seeds: ``kind, host, weight``. Dangling mass is dropped."""
    total = edges.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    steps = cut(edges.join(total, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("out")).alias("share")))
    mass = seeds.groupBy("kind").agg(F.sum("weight").alias("mass"))
    start = cut(seeds.join(mass, "kind").where("mass > 0").select("kind", "host", (F.col("weight") / F.col("mass")).alias("score")))
    score = start
    for k in range(rounds):
        moved = score.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * F.lit(damping)).alias("score"))
        jump = start.select("kind", "host", (F.col("score") * F.lit(1 - damping)).alias("score"))
        score = moved.unionByName(jump).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if (k + 1) % cut_every == 0:
            score = cut(score)
    return score


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.6, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's distrust share, for every page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", rule).withColumn("ruled", ruled)
    links = cut(host_edges(pages, url, html))
    edges = links.withColumn("kind", F.lit("trust")).unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n").withColumn("kind", F.lit("distrust")))
    seeds = judged.where("ruled is not null and host != ''").groupBy(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count(F.lit(1)).alias("weight"))
    score = propagate(edges, seeds, **options)
    pos = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    share = score.groupBy("host").agg((pos("distrust") / (pos("trust") + pos("distrust"))).alias("distrust_share"))
    blocked = cut(share.where(F.round("distrust_share", 9) > threshold))
    out = judged.join(blocked, "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("distrust_share").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
