"""URL filters: fixed rules first, then trust and distrust that spread over the link graph of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, lower_ascii

#: (host, path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
DAMPING = 0.85
#: The spread ends when four rounds together pass on less than this share of the seeds; at 0.85 that takes 120 rounds at most.
TOLERANCE, MAX_ROUNDS = 1e-9, 200
RULES_IN_PLAN = 64
LINK = r"""(?i)\s(?:href|src)\s*=\s*["']?\s*([a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``urls`` (host, path, ...) with rule and rule_verdict, null where none fits; the longest rule wins.

    Few rules become one expression; of more, each URL looks up its host's suffixes by a join.
    """
    spark = urls.sparkSession
    if len(rules) <= RULES_IN_PLAN:
        best = F.lit(None).cast("struct<rule:string,verdict:string>")
        for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
            fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
            best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(best)
        return urls.withColumn("_best", best).select("*", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("rule_verdict")).drop("_best")
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")
    hosts = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = hosts.withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").where("startswith(path, rule_path)")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), F.struct(F.length(F.concat("rule_host", "rule_path")), F.concat("rule_host", "rule_path"))).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def node_of(host: Column) -> Column:
    """A host as a node of the link graph: without user info and port, on both sides of a link."""
    return lower_ascii(F.regexp_replace(host, r"^.*@|:\d*$", ""))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): absolute links between different hosts, counted over all pages."""
    host, _ = host_and_path(F.col("url"))
    links = pages.where(F.col("html").contains("//")).select(node_of(host).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 2)).alias("dst"))
    return links.select("src", node_of(F.col("dst")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(host, score) for hosts that the seeds (host, seed) reach over ``edges``; what hosts without links hold returns to nobody.

    Scores only grow from round to round, so their sum tells how much was still passed on. Without ``rounds`` it goes on
    until that is below ``TOLERANCE``.
    """
    scores = seeds.select("host", (F.lit(1 - damping) * F.col("seed")).alias("score"))
    start, held = scores, 0.0
    if edges.isEmpty():
        return scores
    out = edges.groupBy("src").agg(F.sum("weight").alias("total")).withColumnRenamed("src", "of")
    share = cut(edges.join(out, F.col("src") == F.col("of")).select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    for k in range(MAX_ROUNDS if rounds is None else rounds):
        passed = share.join(scores.withColumnRenamed("host", "src"), "src").groupBy("dst").agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        scores = start.union(passed.select("dst", F.lit(damping) * F.col("got"))).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 4 == 3:
            scores = cut(scores)
            if rounds is None:
                now = scores.agg(F.sum("score")).first()[0] or 0.0
                if now - held < TOLERANCE:
                    break
                held = now
    else:
        if rounds is None:
            raise RuntimeError("scores did not settle")
    return scores


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    Trusted and blocked seeds are the hosts with pages that a rule allows or blocks, in proportion to those pages. Trust
    follows the links, distrust follows them backwards; a page without a rule is blocked if its host's distrust is
    above its trust, else allowed (ties and unknown hosts too). A null URL, or one without ``://``, has an empty host and
    path, fits no rule and is allowed. A null html has no links. Repeated rows are repeated, and their links count again.
    An empty table gives an empty result. Other columns than page_id, url and html are not read; long pages are read whole.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    urls = with_rule(pages.select("page_id", host.alias("host"), path.alias("path")), rules)
    counts = cut(urls.select(node_of(F.col("host")).alias("host"), "rule_verdict").where("host <> ''").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("allowed"), F.count_if(F.col("rule_verdict") == "block").alias("blocked")))
    total = counts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    edges = cut(host_edges(pages))
    trust = personalised_pagerank(edges, counts.where("allowed > 0").select("host", (F.col("allowed") / F.lit(float(total.a or 1))).alias("seed")), damping, rounds)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = personalised_pagerank(back, counts.where("blocked > 0").select("host", (F.col("blocked") / F.lit(float(total.b or 1))).alias("seed")), damping, rounds)
    scored = cut(counts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left").na.fill(0.0))
    own = F.when(F.col("distrust") > F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    joined = urls.join(scored.withColumnRenamed("host", "of"), node_of(F.col("host")) == F.col("of"), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
