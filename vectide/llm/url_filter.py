"""URL filters: rules by host and path, and link-graph propagation for the pages that no rule fits. DataFrame operations only.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end. A url
that is null or has no `://` has an empty host and path, and takes part in nothing. A rule (action, host, path) fits its
host and all subdomains if the url's path starts with the rule's; of several that fit the longest (host and path) wins.

The graph: hosts, and an edge from a page's host to each other host that its html links to (href, absolute or `//`),
weighted by the number of such links. A host is a trusted seed if rules allow over half of its pages, a blocked seed if rules
block over half. Trust is personalised PageRank from the trusted seeds along the links; distrust is the same from the
blocked seeds along the reversed links, so it reaches those who link to blocked hosts. A host is blocked if its distrust is
over `margin` times its trust and it isn't a trusted seed; all others, links or not, are allowed.

Steps go on until at most `TOLERANCE` of the start's mass is still on its way (86 steps at most with DAMPING, fewer where links
lead to sinks); what is left then stays where it is. So ranks are off by TOLERANCE in sum, and trust or distrust that could only
come from seeds over 86 links away isn't counted.

Edges are aggregated before any shuffle of theirs counts: a host with a third of all pages is one row a task. Each step is one
join of edges and ranks by host and one aggregation; ranks are written to the shared folder every `CUT` steps, where the mass
that is left is read. Hosts that only link to themselves leave no edge; without edges the seeds' own ranks are the result and no
step is run. Repeated rows count as pages of their own and stay rows; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

#: (action, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, TOLERANCE, CUT, MARGIN = 0.85, 1e-6, 4, 1.0
LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\s]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first, as the outermost
        fits = ((host_ == own) | host_.endswith(f".{own}")) & path_.startswith(start)
        found = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, weight) of the links between different hosts; pages has host and html."""
    links = pages.where(F.col("host") != "").select(F.col("host").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("target"))
    links = links.withColumn("target", F.translate("target", UPPER, LOWER)).where(F.col("source") != F.col("target"))
    return links.groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank of (host, mass) seeds over (source, target, weight) edges; a sink's rank goes back to the seeds by its (1 - damping) only.

    A host's row holds its rank so far and the mass that arrived in the last step: (1 - damping) of that stays, the rest goes on. Every host
    has an edge to itself (part null) that carries its own rank, so a step reads the ranks once.
    """
    total = edges.groupBy("source").agg(F.sum("weight").alias("total"))
    hosts = edges.select(F.col("source").alias("host")).union(edges.select("target")).union(seeds.select("host")).distinct()
    stay = hosts.select(F.col("host").alias("source"), F.col("host").alias("target"), F.lit(None).cast("double").alias("part"))
    flow = materialize(edges.join(total, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("part")).unionByName(stay), "flow")
    own = F.col("part").isNull()
    kept = F.sum(F.when(own, F.col("rank") + (1 - damping) * F.col("moving")).otherwise(0.0)).alias("rank")
    sent = F.sum(F.when(own, 0.0).otherwise(damping * F.col("moving") * F.col("part"))).alias("moving")
    ranks = materialize(seeds.select("host", F.lit(0.0).alias("rank"), F.col("mass").alias("moving")), "ranks")
    while (ranks.agg(F.sum("moving")).first()[0] or 0.0) > tolerance:
        for _ in range(CUT):
            ranks = ranks.join(flow, ranks["host"] == flow["source"]).groupBy(F.col("target").alias("host")).agg(kept, sent)
        ranks = materialize(ranks, "ranks")
    return ranks.select("host", (F.col("rank") + F.col("moving")).alias("rank"))


def host_verdicts(pages: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(host, trust, distrust, verdict) of all hosts in pages (host, html, action)."""
    pages = pages.where(F.col("host") != "")
    share = lambda action: F.sum(F.when(F.col("action") == action, 1).otherwise(0)) / F.count(F.lit(1))
    hosts = materialize(pages.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    edges = materialize(host_edges(pages), "edges")
    seeds = {}
    for kind in ("allowed", "blocked"):
        own = hosts.where(F.col(kind) > 0.5)
        n = max(1, own.count())
        seeds[kind] = own.select("host", F.lit(1.0 / n).alias("mass"))
    ranks = {kind: own.withColumnRenamed("mass", "rank") for kind, own in seeds.items()}
    if not edges.isEmpty():
        ranks["allowed"] = propagate(edges, seeds["allowed"])
        ranks["blocked"] = propagate(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"), seeds["blocked"])
    trust, distrust = ranks["allowed"].withColumnRenamed("rank", "trust"), ranks["blocked"].withColumnRenamed("rank", "distrust")
    out = hosts.join(trust, "host", "left").join(distrust, "host", "left").select("host", "allowed", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    bad = (F.col("distrust") > margin * F.col("trust")) & (F.col("allowed") <= 0.5)
    return out.select("host", "trust", "distrust", F.when(bad, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url, html)."""
    parsed = pages.select("page_id", "html", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    parsed = parsed.withColumn("found", rule(F.col("host"), F.col("path"), rules)).withColumn("action", F.col("found.action"))
    verdicts = small(host_verdicts(parsed, margin).select("host", F.col("verdict").alias("own")))
    return parsed.drop("html").join(verdicts, "host", "left").select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("action", "own", F.lit("allow")).alias("verdict"))
