"""URL filter by rules and by a path-template tree per host.

Digits in a path become wildcards and equal shapes are counted once with the labels of their pages, so a hot host is a few rows
before anything else happens. Level by level, a branch becomes a wildcard if it is rare among many siblings (a variable
segment), or if its share of bad labels is statistically like that of its siblings (a two-proportion test). The remaining
branches are templates; one is rejected if its smoothed share of good labels is too small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.llm.text import narrow
from kohorta.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host/path) that fits, as text, and its verdict; both missing if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, prefix = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + prefix))
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, decision).otherwise(verdict)
    return text, verdict


def path_templates(shapes: DataFrame, levels: int, rare: int, many: int, z: float) -> DataFrame:
    """shapes (host, shape, n, labelled, bad) with the template of each."""
    rows = shapes.withColumn("segments", F.filter(F.split("shape", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    rows = materialize(rows)
    for level in range(levels):
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        children = rows.where("segment is not null").groupBy("host", "template", "segment").agg(
            F.sum("n").alias("c_n"), F.sum("labelled").alias("c_l"), F.sum("bad").alias("c_b"))
        parents = children.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("kids"), F.sum("c_l").alias("p_l"), F.sum("c_b").alias("p_b"))
        # the share of bad labels beside the siblings'; a branch without labels on either side is like them
        pooled = F.expr("p_b / p_l")
        spread = F.sqrt(pooled * (1 - pooled) * (F.expr("1 / c_l") + F.expr("1 / (p_l - c_l)")))
        gap = F.abs(F.expr("c_b / c_l") - F.expr("(p_b - c_b) / (p_l - c_l)"))
        alike = F.when((F.col("c_l") == 0) | (F.col("p_l") == F.col("c_l")), F.lit(True)).otherwise(
            F.when(spread > 0, gap < z * spread).otherwise(F.lit(True)))
        variable = (F.col("kids") >= many) & (F.col("c_n") <= rare)
        named = children.join(parents, ["host", "template"]).select(
            "host", "template", "segment", F.when((F.col("kids") > 1) & (variable | alike), F.lit("*")).otherwise(
                F.col("segment")).alias("node"))
        rows = rows.join(named, ["host", "template", "segment"], "left").withColumn(
            "template", F.when(F.col("node").isNotNull(), F.concat("template", F.lit("/"), "node")).otherwise(F.col("template"))
        ).drop("node", "segment")
        rows = materialize(rows)  # each level reads the one before three times
    deeper = F.size("segments") > levels
    return rows.withColumn("template", F.when(deeper, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop(
        "segments")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], levels: int = 4, rare: int = 3, many: int = 20,
               z: float = 2.576, weight: float = 10.0, least_purity: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for every row of pages (page_id, url).

    labels has (page_id, bad): bad is 1 or 0, any number of rows a page. The purity of a template is
    ``(good + weight * share of good labels anywhere) / (labelled + weight)``. A rule decides where one fits. A missing url, or
    one without ``://``, has an empty host and path and follows the purity of that group; without any label all is pure.
    Segments beyond ``levels`` share one wildcard. Repeated rows and rows without page_id are each judged; an empty table
    gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = narrow(pages, page_id="bigint", url="string").select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "shape", F.regexp_replace("path", "[0-9]+", "<n>"))
    marks = narrow(labels, page_id="bigint", bad="bigint").where("page_id is not null and bad is not null").groupBy(
        "page_id").agg(F.count(F.lit(1)).alias("labelled"), F.sum("bad").alias("bad"))
    shapes = rows.join(marks, "page_id", "left").groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    found = path_templates(shapes, levels, rare, many, z)
    prior = shapes.agg(F.when(F.sum("labelled") > 0, 1 - F.sum("bad") / F.sum("labelled")).otherwise(F.lit(1.0)).alias("prior"))
    pure = found.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).crossJoin(
        F.broadcast(prior)).select("host", "template", (
            (F.col("l") - F.col("b") + weight * F.col("prior")) / (F.col("l") + weight)).alias("purity"))
    known = found.select("host", "shape", "template").join(pure, ["host", "template"])
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return rows.join(known, ["host", "shape"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")
