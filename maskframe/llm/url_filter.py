"""URL filters with link-graph propagation (DataFrame and SQL functions only).

Rules are (host, path prefix) pairs; a rule fits its host and all subdomains, and the longest one that fits a url wins.
Urls that no rule fits are judged by their host: hosts of which most pages are allowed by rules are trusted seeds, those
of which most are blocked are distrusted ones. Trust flows along links (personalised PageRank), distrust against them
(a host that links to blocked hosts is suspect). A host is blocked if its distrust reaches ``threshold`` (in units of a
seed) and exceeds its trust.

Links are the absolute and scheme-relative href values of the pages; links within a host don't count. Edges are
pre-aggregated by (from, to); every round is two joins and a sum over hosts, written to the shared folder. They end
when the scores stand still; if they still move after ``rounds``, that is an error. The links of a hub meet its one score
in a join of two shuffled tables, which Spark splits where a host has very many, and are summed before the next shuffle;
pages of a popular host meet what is known of it without a shuffle.

Defined cases: null url or one without ``://``: host and path empty, no rule fits, allowed; null html: no links; rules
of equal length: the first in alphabetical order; rows that share an id stay separate; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_each, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, ROUNDS, THRESHOLD, TOLERANCE = 0.85, 200, 0.05, 1e-4


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.coalesce(F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")), F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def judged_by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages(page_id, host, path) with rule and ruled (allow, block or null); rules(verdict, rule).

    Each host is expanded to its suffixes, so the rules are found by equality, however many there are."""
    split = rules.select(
        F.col("verdict").alias("ruled"), F.col("rule"), F.regexp_extract("rule", r"(?s)^([^/]*)", 1).alias("suffix"), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("prefix")
    )
    hosts = pages.select("host").distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix")
    by_host = hosts.select("host", suffix).join(split, "suffix").groupBy("host").agg(F.collect_list(F.struct("ruled", "rule", "prefix")).alias("fitting"))
    out = join_each(pages, by_host, "host")
    own = F.filter("fitting", lambda r: F.startswith(F.col("path"), r["prefix"]))
    best = F.array_min(F.transform(own, lambda r: F.struct((-F.length(r["rule"])).alias("length"), r["rule"].alias("rule"), r["ruled"].alias("ruled"))))
    return out.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.ruled").alias("ruled"))


def links(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> from, to, n: links between different hosts."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))
    each = pages.select(F.col("host").alias("from"), F.explode(found).alias("to")).select("from", F.translate("to", UPPER, LOWER).alias("to"))
    return each.where("`from` <> '' and `from` <> `to`").groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """seeds(host, trusted, blocked: 1 or 0) and edges(from, to, n) -> host, trust, distrust."""
    outward = edges.groupBy("from").agg(F.sum("n").alias("out_n"))
    inward = edges.groupBy("to").agg(F.sum("n").alias("in_n"))
    flow = edges.join(outward, "from").join(inward, "to").select("from", "to", (F.col("n") / F.col("out_n")).alias("forth"), (F.col("n") / F.col("in_n")).alias("back"))
    flow = scratch.save(flow, "flow")
    base = seeds.select("host", F.col("trusted").cast("double").alias("trust"), F.col("blocked").cast("double").alias("distrust"))
    scores = base
    if flow.isEmpty():
        return scores
    # from below, so that a path counts with its own share alone
    scores = base.select("host", *((F.col(c) * F.lit(1 - damping)).alias(c) for c in ("trust", "distrust")))
    for k in range(rounds):
        trust = flow.join(scores.select(F.col("host").alias("from"), "trust"), "from").groupBy(F.col("to").alias("host")).agg(F.sum(F.col("forth") * F.col("trust")).alias("t"))
        distrust = flow.join(scores.select(F.col("host").alias("to"), "distrust"), "to").groupBy(F.col("from").alias("host")).agg(F.sum(F.col("back") * F.col("distrust")).alias("d"))
        zero = F.lit(0.0)
        parts = (
            base.select("host", "trust", "distrust", F.lit(1 - damping).alias("w"))
            .unionByName(trust.select("host", F.col("t").alias("trust"), zero.alias("distrust"), F.lit(damping).alias("w")))
            .unionByName(distrust.select("host", zero.alias("trust"), F.col("d").alias("distrust"), F.lit(damping).alias("w")))
        )
        new = scratch.save(parts.groupBy("host").agg(F.sum(F.col("w") * F.col("trust")).alias("trust"), F.sum(F.col("w") * F.col("distrust")).alias("distrust")), "scores")
        old = scores.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        moved = new.join(old, "host", "left").agg(F.max(F.abs(F.col("trust") - F.coalesce("t0", zero)) + F.abs(F.col("distrust") - F.coalesce("d0", zero)))).first()[0]
        if k:
            scratch.drop(scores)
        scores = new
        if (moved or 0.0) < tolerance:
            break
    else:
        raise RuntimeError(f"scores of hosts still move after {rounds} rounds")
    # in units of a seed that no link reaches
    return scores.select("host", (F.col("trust") / (1 - damping)).alias("trust"), (F.col("distrust") / (1 - damping)).alias("distrust"))


def judge(spark: SparkSession, pages: DataFrame, rules: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, trust, distrust."""
    scratch = Scratch(spark, "url-filter")
    host, path = host_and_path(F.col("url"))
    parsed = scratch.save(pages.select("page_id", host.alias("host"), path.alias("path")), "parsed")
    ruled = scratch.save(judged_by_rules(parsed, rules), "ruled")
    share = ruled.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("allowed"), F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("blocked")
    )
    seeds = share.select("host", (F.col("allowed") > 0.5).cast("int").alias("trusted"), (F.col("blocked") > 0.5).cast("int").alias("blocked"))
    edges = scratch.save(links(pages.select(host.alias("host"), "html")), "edges")
    scores = propagate(edges, scratch.save(seeds, "seeds"), scratch, **options)
    suspect = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce("ruled", F.when(suspect, "block").otherwise("allow"))
    return join_each(ruled, scores, "host").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, rule string")
    return judge(spark, table(spark, sf_dir, "pages"), rules)
