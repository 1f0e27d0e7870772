"""URL filter: host rules, then link-graph propagation for hosts that no rule reaches.

Trust flows from allowed hosts along host links (personalised PageRank); distrust flows from blocked
hosts against them (the same walk on reversed edges). A host whose distrust outweighs its trust is
blocked. Everything is DataFrame work on (host, host) edges; the rule list is the only broadcast side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Fixed values: (verdict, host, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
ROUNDS = 12
DISTRUST_RATIO = 1.0
HUB_LINKS = 100_000  # links of a host that one task sends on
LINK = r'(?i)<a\s[^>]*?href\s*=\s*["\']?((?:https?:)?//[^"\'\s>]+)'


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; empty without `://` or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits the host or a parent of it; else null."""
    fits = [
        F.when(((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def host_edges(pages: DataFrame, parent_links: bool = False) -> DataFrame:
    """Distinct (src, dst) between different hosts: hyperlinks that name a host. parent_links: also a host's link to the
    nearest parent host and back, when both have pages."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"))
    links = links.select(F.col("host").alias("src"), url_host(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))).alias("dst"))
    if parent_links:
        hosts = pages.select("host").where("host != ''").distinct()
        parent = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("dst"))
        parent = parent.join(hosts.select(F.col("host").alias("dst")), "dst").select("src", "dst")
        links = links.union(parent).union(parent.select("dst", "src"))
    return links.where("src != '' and dst != '' and src != dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, name: str, rounds: int = ROUNDS, damping: float = DAMPING, hub_links: int = HUB_LINKS) -> DataFrame:
    """(host, score) after `rounds` steps of personalised PageRank; seeds: (host, weight) summing to 1. A hub's links are
    dealt over as many salts as they need, and its score goes to each."""
    degree = edges.groupBy("src").agg(F.count("*").alias("degree")).withColumn("salts", F.ceil(F.col("degree") / hub_links).cast("long"))
    degree = scratch.keep(degree, f"{name}-degree")
    steps = scratch.keep(edges.join(degree, "src").select("src", F.pmod(F.xxhash64("dst"), F.col("salts")).alias("salt"), "dst"), f"{name}-steps")
    score = seeds.select("host", F.col("weight").alias("score"))
    for i in range(rounds):
        out = degree.join(score.withColumnRenamed("host", "src"), "src").select("src", (F.lit(damping) * F.col("score") / F.col("degree")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        sent = steps.join(out, ["src", "salt"]).select(F.col("dst").alias("host"), "part")
        kept = seeds.select("host", (F.lit(1 - damping) * F.col("weight")).alias("part"))
        score = sent.union(kept).groupBy("host").agg(F.sum("part").alias("score"))
        if i % 4 == 3:
            score = scratch.keep(score, f"{name}-{i}")
    return score


def judge_urls(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", parent_links: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every input row.

    The longest fitting rule decides. Else a host is blocked when its distrust exceeds its trust; a host
    that neither reaches is allowed. A url that is null or lacks `://` has an empty host and path, fits no
    rule and is allowed. Null html has no links, links inside a host say nothing, and of rows that repeat each counts as
    a page. Null ids are kept, other columns ignored. parent_links: as in host_edges. Empty table: no rows.
    """
    scratch = Scratch(pages.sparkSession, "link-rank")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    edges = scratch.keep(host_edges(rows, parent_links), "edges")
    counts = scratch.keep(rows.where("best is not null and host != ''").groupBy("host").agg(F.count_if(F.col("best.verdict") == "allow").alias("good"), F.count_if(F.col("best.verdict") == "block").alias("bad")), "counts")
    total = counts.agg(F.sum("good").alias("goods"), F.sum("bad").alias("bads")).first()
    trusted = counts.where("good > 0").select("host", (F.col("good") / F.lit(float(total["goods"] or 1))).alias("weight"))
    blocked = counts.where("bad > 0").select("host", (F.col("bad") / F.lit(float(total["bads"] or 1))).alias("weight"))
    trust = propagate(edges, trusted, scratch, "trust").withColumnRenamed("score", "trust")
    distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), blocked, scratch, "distrust").withColumnRenamed("score", "distrust")
    scores = scratch.keep(trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "scores")
    out = rows.drop("html").join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    by_graph = F.when(F.col("distrust") > DISTRUST_RATIO * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", by_graph).alias("verdict"), "trust", "distrust")
