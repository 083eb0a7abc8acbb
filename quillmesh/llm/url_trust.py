"""URL filters by link-graph propagation (operator 8).

Rules name a host and a path: a rule fits its host and all subdomains where the url's path starts with
the rule's, and the longest rule wins (equal lengths: block before allow). Pages without a fitting rule
are judged by their host: trust is personalised PageRank from hosts with allowed pages along links,
distrust the same from hosts with blocked pages against the links (a host that links to bad hosts is
suspect). A host is blocked when its distrust per page-weighted seed mass exceeds its trust.

The host graph is one weighted edge per pair of hosts, aggregated before it is shuffled again; each
host's rank is one row; every few rounds the ranks are written to the shared folder.

Null urls, and urls without `://`, have an empty host and path; an empty host takes part in no link
and, without a rule, is allowed. Repeated pages count again; distrust equal to trust allows. Pages of any
length are read whole. An empty table gives no rows. Columns of pages stay, but for those named like an
output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.util import ascii_lower, cut, forget, table

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
INLINE_RULES = 500
DAMPING = 0.85
ROUNDS = 40
TOLERANCE = 1e-3  # mass that may still move in four rounds when propagation ends
#: Block where distrust is more than this many times the trust.
RATIO = 1.0


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fit_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (host, path) with rule and rule_verdict, null where no rule fits. rules: at most INLINE_RULES tuples, or a DataFrame (host, path, verdict)."""
    if not isinstance(rules, DataFrame) and len(rules) > INLINE_RULES:
        rules = pages.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
    if not isinstance(rules, DataFrame):
        best = F.lit(None).cast("struct<rule:string,verdict:string>")
        for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block")):
            fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
            best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(best)
        return pages.withColumn("_r", best).withColumn("rule", F.col("_r.rule")).withColumn("rule_verdict", F.col("_r.verdict")).drop("_r")
    # many rules: distinct (host, first path) shapes are few against pages, so rules join hosts, not pages
    r = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "verdict")
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    u = urls.withColumn("_h", F.explode(up)).join(r, "_h").filter(F.expr("startswith(path, _p)"))
    u = u.groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("_h", "_p")).alias("l"), (F.col("verdict") == "block").alias("b"), F.concat("_h", "_p").alias("rule"), "verdict")).alias("_r"))
    return pages.join(u, ["host", "path"], "left").withColumn("rule", F.col("_r.rule")).withColumn("rule_verdict", F.col("_r.verdict")).drop("_r")


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, w): src's links to each other host, absolute or without a scheme; a base element is a link."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1)))).alias("url"))
    url = F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))
    e = links.select("src", host_of(url).alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst")
    return e.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: (host, rank) from seeds (host, mass; masses sum to 1) along edges (src, dst, w)."""
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    e = cut(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w")))
    base = cut(seeds.select("host", ((1 - damping) * F.col("mass")).alias("rank")))
    rank = seeds.select("host", F.col("mass").alias("rank"))
    if e.isEmpty():  # no links: all mass stays with the seeds
        return rank
    seen = rank
    for k in range(rounds):
        moved = rank.join(e, rank.host == e.src).groupBy("dst").agg((F.sum(F.col("rank") * F.col("w")) * damping).alias("rank")).select(F.col("dst").alias("host"), "rank")
        rank = moved.unionByName(base).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % 4 == 3:  # mass of hosts without links is not dealt out again
            last, rank = seen, cut(rank)
            seen = rank
            moved = rank.join(last.withColumnRenamed("rank", "was"), "host", "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
            if (moved or 0) < TOLERANCE:
                break
            forget(last)
    return rank


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules=RULES, ratio: float = RATIO) -> DataFrame:
    """pages with host, path, rule, trust, distrust and verdict."""
    clash = [c for c in ("host", "path", "rule", "rule_verdict", "trust", "distrust", "verdict") if c in pages.columns and c not in (url, html)]
    p = pages.drop(*clash).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    p = fit_rules(p, rules)
    hosts = cut(p.groupBy("host").agg(F.count(F.when(F.col("rule_verdict") == "allow", 1)).alias("good"), F.count(F.when(F.col("rule_verdict") == "block", 1)).alias("bad"), F.count("*").alias("pages")))
    edges = cut(host_edges(p, html))
    sums = hosts.filter("host <> ''").agg(F.sum(F.col("good") / F.col("pages")), F.sum(F.col("bad") / F.col("pages"))).first()

    def seeds(kind, total):  # a host's share of pages that its rules allow or block
        return hosts.filter((F.col("host") != "") & (F.col(kind) > 0)).select("host", (F.col(kind) / F.col("pages") / F.lit(float(total or 1.0))).alias("mass"))

    trust = propagate(edges, seeds("good", sums[0])).withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = propagate(back, seeds("bad", sums[1])).withColumnRenamed("rank", "distrust")
    scores = hosts.join(trust, "host", "left").join(distrust, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    # shares of the total mass: a host with as much of the distrust as of the trust is in balance
    scores = cut(scores.withColumn("host_verdict", F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow")))
    p = p.join(scores, "host", "left")
    return p.withColumn("verdict", F.coalesce("rule_verdict", "host_verdict"))


def op8(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
