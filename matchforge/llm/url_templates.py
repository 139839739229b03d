"""Operator 11: URL filters by rules and by a tree of path templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Name of a segment that no literal and no shape stands for.
ANY = "{any}"


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null and where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule is ``host/path`` with its verdict; of equally long ones the first by text wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict_, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, below = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + below)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, verdict_).otherwise(verdict)
    return rule, verdict


def segments(path: Column, depth: int) -> Column:
    """What stands between slashes; from ``depth`` on all is one segment. The empty path has none."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(path, 2, 1 << 30), "/", depth))


def generalised(paths: DataFrame, depth: int, least: int, share: float) -> DataFrame:
    """``paths`` (host, segs, n, ...) with ``nodes``, its template, level by level.

    Of what follows a node, a segment stays literal with at least ``least`` of the pages and
    ``share`` of the node's. Others go by shape, digits read as ``{n}``, if the shape has as
    many, and else are ``{any}``; so a node has a bounded number of branches.
    """
    deepest = paths.agg(F.max(F.size("segs"))).first()[0] or 0
    out = paths.withColumn("nodes", F.array().cast("array<string>"))
    enough = lambda n: (F.col(n) >= least) & (F.col(n) >= F.col("here") * share)
    for level in range(1, min(deepest, depth) + 1):
        at = out.withColumn("seg", F.get("segs", F.lit(level - 1)))
        at = at.withColumn("shape", F.regexp_replace("seg", "[0-9]+", "{n}"))
        seen = at.where("seg is not null").groupBy("host", "nodes", "seg", "shape").agg(F.sum("n").alias("n"))
        here = seen.groupBy("host", "nodes").agg(F.sum("n").alias("here"))
        literal = seen.join(here, ["host", "nodes"]).where(enough("n")).select("host", "nodes", "seg", F.lit(True).alias("literal"))
        rest = seen.join(literal, ["host", "nodes", "seg"], "left_anti").groupBy("host", "nodes", "shape").agg(F.sum("n").alias("of_shape"))
        shapes = rest.join(here, ["host", "nodes"]).where(enough("of_shape")).select("host", "nodes", "shape", F.lit(True).alias("shaped"))
        named = at.join(literal, ["host", "nodes", "seg"], "left").join(shapes, ["host", "nodes", "shape"], "left")
        name = F.when(F.col("literal"), F.concat(F.lit("="), F.col("seg"))).when(F.col("shaped"), F.col("shape")).otherwise(ANY)
        # A literal carries a mark, so that no segment can pass for a wildcard.
        grown = named.withColumn("nodes", F.when(F.col("seg").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array(name)))).drop("seg", "shape", "literal", "shaped")
        before, out = out, durable(grown)
        if level > 1:
            release(before)
    return out


def tree(paths: DataFrame, weight: float, doubt: float, threshold: float) -> DataFrame:
    """host, nodes, pages, labelled, blocked, share and verdict of every template.

    Branches of one node whose pages mostly end alike are put in order of their blocked share,
    and neighbours in it are merged unless that share, or the share of pages that end so,
    differs by more than Hoeffding's bound allows at ``doubt``. Branches without labelled
    pages merge with each other only. A template's share is then smoothed from the root down:
    each step adds ``weight`` pages of the share above it to the merged branch's own. It is
    blocked from ``threshold`` on, if its host has labelled pages at all.
    """
    leaves = paths.groupBy("host", "nodes").agg(F.sum("n").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    leaves = durable(leaves)
    total = leaves.agg(F.sum("blocked").alias("k"), F.sum("labelled").alias("n")).first()
    base = ((total["k"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)
    below = leaves.select("*", F.explode(F.sequence(F.lit(0), F.size("nodes"))).alias("level"))
    below = below.select("host", F.slice("nodes", 1, F.col("level")).alias("node"), F.col("nodes").alias("leaf"), "level", "pages", "labelled", "blocked", F.array_join(F.expr("slice(nodes, level + 1, size(nodes))"), "/").alias("rest"))
    sums = [F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.sum("pages").alias("pages")]
    ends = below.groupBy("host", "node", "level", "rest").agg(*sums)
    nodes = ends.groupBy("host", "node", "level").agg(*sums, F.max_by("rest", F.struct("pages", "rest")).alias("shape"), F.max("pages").alias("most"))
    nodes = nodes.withColumn("above", F.expr("slice(node, 1, greatest(level - 1, 0))")).withColumn("known", F.col("labelled") > 0)
    own = F.when(F.col("known"), F.col("blocked") / F.col("labelled")).otherwise(0.0)
    nodes = nodes.withColumn("own", own).withColumn("like", F.col("most") / F.col("pages"))
    beside = ["host", "level", "above", "shape", "known"]
    order = Window.partitionBy(*beside).orderBy("own", "node")
    z = math.sqrt(math.log(2 / doubt) / 2)

    def differs(value: str, size: str) -> Column:
        bound = z * (1 / F.sqrt(F.col(size).cast("double")) + 1 / F.sqrt(F.lag(size).over(order).cast("double")))
        return F.abs(F.col(value) - F.lag(value).over(order)) > bound

    apart = differs("like", "pages") | (F.col("known") & differs("own", "labelled"))
    nodes = nodes.withColumn("new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("branch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = Window.partitionBy(*beside, "branch")
    nodes = nodes.select("host", "node", F.sum("labelled").over(merged).alias("n"), F.sum("blocked").over(merged).alias("k"))
    steps = below.select("host", "leaf", "level", "node").join(nodes, ["host", "node"]).groupBy("host", "leaf").agg(F.array_sort(F.collect_list(F.struct("level", "n", "k"))).alias("steps"))
    fold = F.aggregate("steps", F.lit(base), lambda p, x: (x["k"] + p * weight) / (x["n"] + weight))
    # The first step is the host: without a labelled page there, nothing speaks against a template.
    out = leaves.join(steps.select("host", F.col("leaf").alias("nodes"), fold.alias("share"), (F.get("steps", F.lit(0))["n"] > 0).alias("seen")), ["host", "nodes"])
    return out.withColumn("verdict", F.when(F.col("seen") & (F.col("share") >= threshold), "block").otherwise("allow")).drop("seen")


def judge(pages: DataFrame, rules: list[tuple[str, str]], depth: int = 8, least: int = 5, share: float = 0.05, weight: float = 10.0, doubt: float = 0.05, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template.

    Pages that a rule fits are the labelled ones, and keep its verdict. All pages make the
    tree, and the others get the verdict of their template. ``template`` shows a literal
    segment as ``=text``.

    A null URL, or one without ``://``, has an empty host and path, which are a host and a
    template like others. Segments from ``depth`` on count as one. Null ids stay null, repeated
    rows count as often as they come and each get a row. URLs of any length are read whole.
    An empty table gives an empty result. No other column is read.
    """
    host, path = parse(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict)
    known, bad = F.col("rule").isNotNull(), F.col("by_rule") == "block"
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    paths = durable(rows.groupBy("host", "path").agg(F.count("*").alias("n"), count(known).alias("labelled"), count(bad).alias("blocked")).withColumn("segs", segments(F.col("path"), depth)))
    made = generalised(paths, depth, least, share)
    templates = tree(made, weight, doubt, threshold)
    of_path = durable(made.select("host", "path", "nodes").join(templates.select("host", "nodes", F.col("verdict").alias("by_tree")), ["host", "nodes"]))
    out = rows.join(of_path, ["host", "path"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_tree").alias("verdict"), F.array_join("nodes", "/").alias("template"))
