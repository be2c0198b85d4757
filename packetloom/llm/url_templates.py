"""URL filters by a tree of path templates per host.

Every url becomes its host and a list of path segments with digits and long hex strings
replaced by marks. Level by level the tree of a host is narrowed: a segment that is one of
many children and rare among them becomes a wildcard, and children whose share of blocked
pages does not differ from that of their siblings are merged into one. Each template that
remains is rejected if the smoothed share of blocked pages among its labelled ones is high.
Only aggregated paths move between the levels; pages are read twice, to count and to judge.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import lookup, stored, table

#: (rule, verdict); the host is what stands before the first slash, the path the rest.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Levels of the tree; what lies deeper is one segment, `**`.
DEPTH = 8
#: A node with more children than this may turn the rare ones into a wildcard.
CHILDREN = 32
#: Rare: less than this share of the node's pages.
RARE = 1 / 64
#: Labelled pages that a branch and its siblings need before they are compared.
EVIDENCE = 20
#: Branches closer than this many standard errors are similar.
SIMILAR = 2.0
#: Weight and value of the prior of the purity, and the purity beyond which a template is rejected.
PRIOR_WEIGHT, PRIOR = 4.0, 0.5
REJECT = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty if the url is null or has no ://; the host in lower case."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, below = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """Segments of a path, variable characters replaced, as an array of at most DEPTH."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    marked = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(
        F.lower(s), r"[0-9a-f]{8}[0-9a-f-]{8,}", "<hex>"), r"[0-9]+", "<n>"))
    return F.when(F.size(marked) <= DEPTH, marked).otherwise(
        F.concat(F.slice(marked, 1, DEPTH - 1), F.array(F.lit("**"))))


def grow(paths: DataFrame) -> DataFrame:
    """Templates of paths (key, host, shape, n, labelled, blocked): adds template."""
    tree = stored(paths.withColumn("template", F.array().cast("array<string>")), "tree")
    deepest = tree.agg(F.max(F.size("shape"))).first()[0] or 0
    for level in range(deepest):
        tree = tree.withColumn("segment", F.get("shape", F.lit(level)))
        children = tree.filter("segment IS NOT NULL").groupBy("host", "template", "segment").agg(
            F.sum("n").alias("c_n"), F.sum("labelled").alias("c_l"), F.sum("blocked").alias("c_b"))
        nodes = children.groupBy("host", "template").agg(
            F.count("*").alias("width"), F.sum("c_n").alias("p_n"), F.sum("c_l").alias("p_l"),
            F.sum("c_b").alias("p_b"))
        both = children.join(nodes, ["host", "template"])
        rare = (F.col("width") > CHILDREN) & (F.col("c_n") < RARE * F.col("p_n"))
        rest = F.col("p_l") - F.col("c_l")
        pooled = F.try_divide("p_b", "p_l")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "c_l") + F.try_divide(F.lit(1), rest)))
        apart = F.abs(F.try_divide("c_b", "c_l") - F.try_divide(F.col("p_b") - F.col("c_b"), rest))
        alike = (F.col("c_l") >= EVIDENCE) & (rest >= EVIDENCE) & (apart <= SIMILAR * error)
        named = F.when(rare | F.coalesce(alike, F.lit(False)), "*").otherwise(F.col("segment"))
        chosen = both.select("host", "template", "segment", named.alias("as"))
        tree = stored(tree.join(chosen, ["host", "template", "segment"], "left").withColumn(
            "template", F.when(F.col("as").isNull(), F.col("template")).otherwise(
                F.concat("template", F.array("as")))).drop("segment", "as"), f"tree-{level}")
    return tree


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Verdict for each row of pages (page_id, url).

    page_id, host, path, rule, verdict (allow or block), template, purity (the smoothed share of
    blocked ones among the pages of the template that a rule labels).

    A rule's verdict holds where one fits, the template's elsewhere; templates without labelled
    pages have the prior purity and are allowed. A null url, or one without ://, has empty host and
    path. Repeated rows are judged each; an empty table gives no rows; other columns are not looked
    at.
    """
    urls = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"),
                       shape(F.col("path")).alias("shape"))
    urls = urls.withColumn("key", F.concat_ws("/", "host", F.array_join("shape", "/")))
    paths = urls.groupBy("key", "host", "shape").agg(
        F.count("*").alias("n"), F.count("says").alias("labelled"),
        F.count(F.when(F.col("says") == "block", 1)).alias("blocked"))
    tree = grow(paths)
    found = tree.groupBy("host", "template").agg(
        F.sum("labelled").alias("t_l"), F.sum("blocked").alias("t_b"))
    found = found.withColumn(
        "purity", (F.col("t_b") + PRIOR_WEIGHT * PRIOR) / (F.col("t_l") + PRIOR_WEIGHT))
    facts = stored(tree.join(found, ["host", "template"]).select(
        "key", "n", F.array_join("template", "/").alias("template"), "purity"), "templates")
    total = facts.agg(F.sum("n")).first()[0] or 0
    judged = lookup(urls, facts, "key", F.col("n"), total)
    by_template = F.when(F.col("purity") > REJECT, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule",
                         F.coalesce("says", by_template).alias("verdict"), "template", "purity")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
