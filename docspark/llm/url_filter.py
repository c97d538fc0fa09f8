"""URL filter: longest rules first; hosts without one are judged by trust and distrust that spread over links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.plans.storage import cut, written

#: (verdict, host, path) of the rules the registered query uses. Fixed values.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_HOST_NAME = r"[a-z0-9-]+(?:\.[a-z0-9-]+)+"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty if null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(out)
    return out


def _site(host: Column) -> Column:
    """The host without its first label, if three labels remain: what www., m. and blog. hosts belong to."""
    return F.when(host.rlike(r"^[^.]+(?:\.[^.]+){3,}$"), F.regexp_replace(host, r"^[^.]+\.", ""))


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, n): pages of the source host that name the target, in a link or in their text, and ties of hosts
    to their site and back, by the host's pages.

    Only hosts that have pages, and their sites, are targets; a page counts once for each; loops are left out.
    """
    hosted = pages.select("host", "html").where("host <> ''")
    size = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("n")).withColumn("site", _site(F.col("host")))
    ties = size.where("site is not null")
    ties = ties.select(F.explode(F.array(F.struct(F.col("host").alias("source"), F.col("site").alias("target")), F.struct(F.col("site").alias("source"), F.col("host").alias("target")))).alias("e"), "n").select("e.source", "e.target", "n")
    known = size.select(F.explode(F.array_compact(F.array("host", "site"))).alias("target")).distinct()
    named = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("html", F.lit(""))), F.lit(_HOST_NAME), F.lit(0)))
    cited = hosted.select(F.col("host").alias("source"), F.explode(named).alias("target")).where("source <> target")
    cited = cited.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")).join(known, "target", "left_semi")
    return cited.select("source", "target", "n").unionByName(ties).groupBy("source", "target").agg(F.sum("n").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank: trust along links from trusted seeds, distrust against them.

    ``seeds`` has host, trust, distrust (weights, not negative). Each kind's seeds are scaled to sum to 1; mass at hosts
    without links onward is lost. A kind without seeds is 0 everywhere. Lineage is cut every fifth round.
    """
    ways = links.select(F.lit("trust").alias("kind"), "source", "target", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n"))
    out = ways.groupBy("kind", "source").agg(F.sum("n").alias("all"))
    edges = written(ways.join(out, ["kind", "source"]).select("kind", F.col("source").alias("host"), "target", (F.col("n") / F.col("all")).alias("share")), "url-edges")
    start = seeds.select("host", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("seed")) for k in ("trust", "distrust")))).alias("s")).select("s.kind", "host", "s.seed").where("seed > 0")
    total = start.groupBy("kind").agg(F.sum("seed").alias("all"))  # two rows at most
    start = written(start.join(F.broadcast(total), "kind").select("kind", "host", (F.col("seed") / F.col("all")).alias("seed")), "url-seeds")
    rank = start.withColumnRenamed("seed", "rank")
    for i in range(rounds):
        moved = rank.join(edges, ["kind", "host"]).select("kind", F.col("target").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        rank = moved.unionByName(start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if i % 5 == 4:
            rank = cut(rank)
    kinds = (F.sum(F.when(F.col("kind") == k, F.col("rank"))).alias(k) for k in ("trust", "distrust"))
    return rank.groupBy("host").agg(*kinds).na.fill(0.0)


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, margin: float = 0.0) -> DataFrame:
    """Verdict on every url of ``pages`` (page_id, url, html).

    Returns one row per row: page_id, host, path, rule, verdict (allow or block), trust, distrust. The longest rule
    that fits the host (or a domain above it) and the path's beginning decides. Hosts with pages that rules allow or
    block are the seeds, weighted by those pages; other pages are blocked if their host's distrust exceeds its trust by
    more than ``margin`` of the mean host's share, else allowed. Null urls and urls without ``://`` have an empty host
    and path, and are allowed. Null html has no links; repeated rows count and are judged each; an empty table gives no
    rows; very long html is read whole.
    """
    rules = RULES if rules is None else rules
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    judged = judged.withColumn("ruled", _ruled(F.col("host"), F.col("path"), rules))
    by_host = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled.verdict") == "allow").alias("trust"), F.count_if(F.col("ruled.verdict") == "block").alias("distrust"))
    by_host = cut(by_host)
    scores = cut(spread(host_links(judged), by_host))
    over = margin / max(1, by_host.count())
    bad = by_host.select("host").join(scores, "host", "left").na.fill(0.0)
    # written, its size tells Spark whether to broadcast it; beyond, a host of many pages is split by adaptive execution
    bad = written(bad.withColumn("by_host", F.when(F.col("distrust") - F.col("trust") > over, "block").otherwise("allow")), "url-hosts")
    out = judged.drop("html").join(bad, "host", "left")
    verdict = F.coalesce(F.col("ruled.verdict"), F.col("by_host"), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
