"""URL filtering: path rules first, then trust and distrust spread over the graph of hosts.

Pages link hosts: an edge runs from a page's host to the host of each absolute link in its HTML (with
a scheme, or beginning with ``//``), weighed by how many links there are; relative links stay on their
host and are none. A host and its parent domains up to the registrable domain count as linked once
each way, so that a site's hosts share what is known of it; hosts under a public suffix don't meet
there. A public suffix is a last label, or a last label of two letters after one of ``SECOND``
(``co.uk``); a list of further ones is a parameter.

Trust is personalised PageRank from the hosts of allowed pages along the edges; distrust is the same
walk from the hosts of blocked pages against the edges (who links to bad hosts is bad). A seed weighs as
much as it has pages, in either walk alike: a walk's scores sum to its part of all seeds' pages, so
that a blocked page counts as much as an allowed one however many there are of each. What reaches hosts
without edges returns to the seeds. Steps go on until they move less than ``TOLERANCE`` in all. A url
without a rule is blocked if its host has more than ``FACTOR`` times as much distrust as trust; a
host that neither walk reaches is allowed.

Pages are read once, into a narrow table of hosts, paths and linked hosts. Rows meet in sums by host
or by pair of hosts, aggregated before they are shuffled; hosts with over a thousandth of all edges
are salted. Ranks are written to the shared folder after each few steps.

Defined cases: null urls and urls without ``://`` have empty host and path, no rule, and are allowed;
null HTML has no links; links without a host are skipped; repeated pages are judged alike, and their
links count as often; other columns are dropped unless they are keys; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.common import joined_apart, materialise, read, reopened

#: host, path, verdict
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING, TOLERANCE, FACTOR = 0.85, 1e-4, 1.0
#: Edges that a task of the walks' steps passes on, about.
EDGES = 50_000
#: Labels that make a public suffix of two with a country's label after them.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def linked_hosts(html: Column) -> Column:
    """The hosts of all absolute links of a page, as often as they are linked."""
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?i)href\\s*=\\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\\s>]+)"), 1)
    hosts = F.transform(links, lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("x:"), x)).otherwise(x)))
    return F.filter(hosts, lambda x: x != "")


def suffix_labels(labels: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """How many of a host's labels are its public suffix."""
    two = F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))
    country = (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(*SECOND)
    return F.when(F.size(labels) < 2, 1).when(country | two.isin(*suffixes), 2).otherwise(1)


def host_edges(judged: DataFrame) -> DataFrame:
    """host, links -> src, dst, n: links between different hosts."""
    hosts = judged.select(F.col("host").alias("src"), F.explode("links").alias("dst"))
    return hosts.where("src != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def kin_edges(judged: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """host -> src, dst, n: each host and its parents up to the registrable domain, both ways."""
    hosts = judged.where("host != ''").select("host").distinct().select(F.split("host", "\\.").alias("labels"))
    hosts = hosts.withColumn("steps", F.size("labels") - suffix_labels(F.col("labels"), suffixes) - 1).where("steps > 0")
    name = lambda i: F.array_join(F.slice("labels", i, F.size("labels")), ".")
    pairs = hosts.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("steps")), lambda i: F.struct(name(i).alias("a"), name(i + 1).alias("b")))).alias("e")).select("e.*").distinct()
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"))
    return both.select("e.*", F.lit(1).cast("bigint").alias("n"))


def _steady(spark: SparkSession, parts: int) -> SparkSession:
    """A session whose plans are fixed beforehand, in at most as many partitions as the given one's.

    Adaptive execution starts a thread of the driver for every shuffle and every broadcast and keeps it for a
    minute, and plans and describes what is left of the steps anew after each: hundreds of MB for small tables too.
    """
    out = spark.newSession()
    out.conf.set("spark.sql.adaptive.enabled", "false")
    out.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out.conf.set("spark.sql.shuffle.partitions", str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)))
    return out


def _salted(ranks: DataFrame, hot: DataFrame | None) -> DataFrame:
    """walk, host, score, moved -> walk, src, score, moved; with hot hosts, once for each of their salts."""
    if hot is None:
        return ranks.withColumnRenamed("host", "src")
    salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)) - 1)
    return ranks.join(hot, ["walk", "host"], "left").select("walk", F.col("host").alias("src"), F.explode(salts).alias("salt"), "score", "moved")


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, every: int = 8, most: int = 240, whole: bool = True) -> DataFrame:
    """Personalised PageRank of several walks at once: each walk's scores sum to 1, or else are in units of its seeds' mass.

    Edges (walk, src, dst, n) and seeds (walk, host, mass) -> walk, host, score. The walk without its
    dangling mass is stepped; as that mass returns to the seeds, the whole walk's scores are the same
    up to their sum. Steps shrink what is left by ``damping`` at least. Edges of sources with over a
    thousandth of all are salted by their targets, and those sources' scores are repeated a salt.
    The steps run in a session of their own (``_steady``), ``every`` of them in one plan, which
    shuffles the shares once and the scores once a step. What a step has moved is carried beside
    the scores, as it is spread by the same shares. A step's sums leave tasks of some ``EDGES`` edges,
    however many partitions the session shuffles into, so that a small graph writes few files.
    """
    most_edges = max(1000, edges.count() // 1000)
    out = edges.groupBy("walk", "src").agg(F.sum("n").alias("out"), F.ceil(F.count("*") / most_edges).alias("salts"))
    out = materialise(out, "host-degrees")
    shares = edges.join(out, ["walk", "src"]).select("walk", "src", F.pmod(F.xxhash64("dst"), F.col("salts")).alias("salt"), "dst", (F.col("n") / F.col("out")).alias("share"))
    shares = materialise(shares, "host-shares")
    sums = seeds.groupBy("walk").agg(F.sum("mass").alias("all"))
    masses = materialise(sums, "host-masses")
    seeds = materialise(seeds.join(F.broadcast(masses), "walk").select("walk", "host", (F.col("mass") / F.col("all")).alias("score")), "host-seeds")
    parts = shares.count() // EDGES + 1
    steady = _steady(edges.sparkSession, parts)
    shares, hot = reopened(shares, steady), reopened(out, steady).where("salts > 1").select("walk", F.col("src").alias("host"), "salts")
    hot = None if hot.isEmpty() else F.broadcast(hot)
    seeds = reopened(seeds, steady)
    # the first step moves away from the seeds, whose scores are all that has moved before it
    first, start = (seeds.select("walk", "host", ((1 - damping) * F.col("score")).alias("score"), (x * F.col("score")).alias("moved")) for x in (-damping, 0.0))
    ranks = seeds.withColumn("moved", F.col("score"))
    for at in range(0, most, every):
        for i in range(every):
            sent = shares.join(_salted(ranks, hot), ["walk", "src", "salt"] if hot else ["walk", "src"]).select("walk", F.col("dst").alias("host"), *((damping * F.col(c) * F.col("share")).alias(c) for c in ("score", "moved")))
            ranks = sent.union(start if at + i else first).coalesce(parts).groupBy("walk", "host").agg(F.sum("score").alias("score"), F.sum("moved").alias("moved"))
        ranks = materialise(ranks.coalesce(parts), "host-ranks")
        left = ranks.agg(F.sum(F.abs("moved"))).first()[0] or 0.0
        if left <= tolerance:
            ranks = reopened(ranks, edges.sparkSession).select("walk", "host", "score")
            factor = ranks.groupBy("walk").agg((1 / F.sum("score")).alias("by")) if whole else masses.select("walk", F.col("all").alias("by"))
            return ranks.join(F.broadcast(factor), "walk").select("walk", "host", (F.col("score") * F.col("by")).alias("score")).where("score > 0")
    raise RuntimeError(f"the walks still move {left} after {most} steps")


def ruled(pages: DataFrame, keys: list[str | Column], rules: tuple = RULES) -> DataFrame:
    """url, html -> the keys, host, path, fit (rule and verdict), links."""
    placed = pages.select(*keys, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), linked_hosts(F.col("html")).alias("links"))
    return placed.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))


def host_scores(judged: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``ruled`` -> host, trust, distrust: of every host that a walk reaches."""
    edges = materialise(host_edges(judged).union(kin_edges(judged, suffixes)).groupBy("src", "dst").agg(F.sum("n").alias("n")), "host-edges")
    both = edges.select(F.lit("allow").alias("walk"), "src", "dst", "n").union(edges.select(F.lit("block"), "dst", "src", "n"))
    seeds = judged.where("host != '' and fit is not null").groupBy(F.col("fit.verdict").alias("walk"), "host").agg(F.count("*").alias("mass"))
    own = lambda walk: F.sum(F.when(F.col("walk") == walk, F.col("score")).otherwise(0.0))
    return spread(both, seeds, whole=False).groupBy("host").agg(own("allow").alias("trust"), own("block").alias("distrust"))


def judge_urls(pages: DataFrame, keys: list[str], rules: tuple = RULES, factor: float = FACTOR, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """url, html -> the key columns, host, path, rule, verdict, trust and distrust of every page."""
    judged = materialise(ruled(pages, [F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], rules), "ruled-pages")
    scores = materialise(host_scores(judged, suffixes), "host-scores")
    pages_of = judged.groupBy("host").agg(F.count("*").alias("n"))
    hot = scores.join(F.broadcast(pages_of.where(F.col("n") > max(1000, judged.count() // 1000)).select("host")), "host", "left_semi")
    joined = joined_apart(judged.drop("links"), scores, hot, "host")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    found = F.when(distrust > factor * trust, "block").otherwise("allow")
    own = [F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)]
    return joined.select(*own, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", found).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op9_host_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id"])
