"""URL filters: path rules first, then trust and distrust carried along host links.

Every url is split into host and path.  The longest fitting rule decides.  Hosts whose
urls the rules allow are trusted seeds, those they block are blocked seeds.  Trust is
personalised PageRank from the trusted seeds along the links between hosts; distrust
is the same walk from the blocked seeds along the reversed links, so that it reaches
hosts that link to bad ones.  A host's verdict compares the two with a threshold and
holds for all its urls without a rule.

The graph has hosts as nodes and distinct links as edges.  Edges stay in Spark; an
iteration is one join and one aggregation, and every few of them are written to the
shared folder to cut the lineage.  The walks go on until they have reached all hosts they
can and their scores have settled.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A walk has settled when its scores change by no more than this in sum, and each by no more than this share of it.
TOLERANCE = 1e-9
#: Rules up to this number are literals in the plan; more of them are joined.
LITERAL_RULES = 500


def host_of(url):
    """From after the first :// to /, ?, # or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^(?:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, UPPER.lower())


def path_of(url):
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host, path, rule_host, rule_path):
    return ((host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))) & path.startswith(rule_path)


def apply_rules(spark: SparkSession, sites: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule and rule_verdict to distinct (host, path) rows.

    A rule is a string ``host/path`` and its verdict; it fits its host and all
    subdomains if the url's path starts with the rule's.  The longest rule wins, equally
    long ones by code point.  Many rules are met by a join on the host's suffixes,
    few by literals, with the same result.
    """
    rows = [(r, r.partition("/")[0], "/" + r.partition("/")[2] if "/" in r else "", v) for r, v in rules]
    order = sorted(rows, key=lambda r: (-len(r[0]), r[0]))
    if len(order) <= LITERAL_RULES:
        rule = verdict = F.lit(None).cast("string")
        for text, host, path, said in reversed(order):
            fits = _fits(F.col("host"), F.col("path"), F.lit(host), F.lit(path))
            rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
        return sites.withColumns({"rule": rule, "rule_verdict": verdict})
    table = spark.createDataFrame(order, "rule string, rule_host string, rule_path string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    met = (
        sites.withColumn("rule_host", F.explode(suffixes))
        .join(table, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "rule_verdict")).alias("_best"))
        .select("host", "path", "_best.rule", "_best.rule_verdict")
    )
    return sites.join(met, ["host", "path"], "left")


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links (src, dst) between different hosts, from the href attributes.

    Links that name no host stay on their own host and carry nothing.
    """
    targets = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""), F.lit(1))
    full = F.when(F.col("_to").startswith("//"), F.concat(F.lit("http:"), F.col("_to"))).otherwise(F.col("_to"))
    return (
        pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(targets)).alias("_to"))
        .select("src", host_of(full).alias("dst"))
        .where("src <> '' AND dst <> '' AND src <> dst")
        .distinct()
    )


def walk(
    spark: SparkSession, edges: DataFrame, seeds: DataFrame, folder: str, name: str, damping: float, rounds: int | None = None, every: int = 5
) -> DataFrame:
    """host, score: personalised PageRank over ``edges`` (src, dst) from ``seeds`` (host, weight).

    Weights sum to 1.  What reaches a host without links is dropped, like the walks that
    end; it would return to the seeds and scale all scores alike.  Without a number of
    ``rounds`` the walk goes on until a round reaches no new host and changes the scores
    by TOLERANCE at most, which is looked at every few rounds.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    spread = materialise(spark, edges.join(degree, "src").select("src", "dst", (F.lit(damping) / F.col("degree")).alias("share")), folder, f"{name}-edges")
    start = seeds.select("host", (F.lit(1 - damping) * F.col("weight")).alias("score"))
    score = seeds.select("host", F.col("weight").alias("score"))
    if spread.isEmpty():
        return start
    for k in itertools.count(1):
        moved = score.join(spread, score.host == spread.src).select(F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score"))
        terms = moved.unionByName(start)
        if rounds is not None or k % every:
            score = terms.groupBy("host").agg(F.sum("score").alias("score"))
            if k == rounds:
                return materialise(spark, score, folder, f"{name}-last")
            if k % every == 0:
                score = materialise(spark, score, folder, f"{name}-{k}")
            continue
        was = score.select("host", F.lit(0.0).alias("score"), F.col("score").alias("was"))
        both = terms.withColumn("was", F.lit(None).cast("double")).unionByName(was)
        both = materialise(spark, both.groupBy("host").agg(F.sum("score").alias("score"), F.sum("was").alias("was")), folder, f"{name}-{k}")
        change = F.abs(F.col("score") - F.col("was"))
        seen = both.agg(
            F.count_if(F.col("was").isNull()).alias("fresh"),
            F.coalesce(F.sum(change), F.lit(0.0)).alias("sum"),
            F.coalesce(F.max(F.when(F.col("score") > 1e-290, change / F.col("score"))), F.lit(0.0)).alias("share"),
        ).first()
        score = both.select("host", "score")
        if not seen["fresh"] and seen["sum"] <= TOLERANCE and seen["share"] <= TOLERANCE:
            return score


def _seeds(hosts: DataFrame, kind: str) -> DataFrame:
    some = hosts.where(F.col(kind) > 0).select("host", F.col(kind).cast("double").alias("w"))
    total = some.agg(F.sum("w").alias("t"))
    return some.join(F.broadcast(total)).select("host", (F.col("w") / F.col("t")).alias("weight"))


def url_filter(
    spark: SparkSession,
    pages: DataFrame,
    rules: list[tuple[str, str]],
    damping: float = 0.85,
    rounds: int | None = None,
    threshold: float = 0.0,
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust; one row for each page.

    Without a rule a url is blocked where its host's distrust exceeds its trust by more
    than ``threshold``, else allowed; hosts that no walk reaches have 0 of both.  The
    walks settle unless ``rounds`` limits them.  A
    host that rules both allow and block somewhere is a seed of either kind by the
    number of its urls.  A null url, or one without ``://``, has an empty host and
    path and is no seed.  Null html has no links.  Repeated pages give repeated rows;
    an empty table gives an empty result.  Only page_id, url and html are read.
    """
    folder = shared_dir(spark)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    sites = materialise(
        spark, apply_rules(spark, urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), rules), folder, "sites"
    )
    hosts = materialise(
        spark,
        sites.where("host <> ''")
        .groupBy("host")
        .agg(
            F.sum(F.when(F.col("rule_verdict") == "allow", F.col("n")).otherwise(0)).alias("allowed"),
            F.sum(F.when(F.col("rule_verdict") == "block", F.col("n")).otherwise(0)).alias("blocked"),
        ),
        folder,
        "hosts",
    )
    edges = materialise(spark, host_links(pages), folder, "links")
    trust = walk(spark, edges, _seeds(hosts, "allowed"), folder, "trust", damping, rounds)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = walk(spark, back, _seeds(hosts, "blocked"), folder, "distrust", damping, rounds)
    judged = (
        sites.join(trust.withColumnRenamed("score", "trust"), "host", "left")
        .join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
        .na.fill(0.0, ["trust", "distrust"])
        .withColumn(
            "verdict",
            F.coalesce(
                "rule_verdict",
                F.when(F.col("distrust") - F.col("trust") > threshold, F.lit("block")).otherwise(F.lit("allow")),
            ),
        )
    )
    return urls.join(judged.drop("n", "rule_verdict"), ["host", "path"]).select(
        "page_id", "host", "path", "rule", "verdict", "trust", "distrust"
    )
