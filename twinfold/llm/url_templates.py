"""URL filter: a tree of path templates per host, judged by smoothed labelled purity.

Rules give some pages a label (allow or block). The paths of every host form a tree, one segment per level.

1. *Generalise.* At every node a segment keeps its name if at least ``min_count`` pages have it there, however many the node
   has. Rarer segments become their shape (runs of digits as ``#``) if the shape is as common, else ``*``.
2. *Merge.* Named branches of a node that lean the same way (mostly allowed, mostly blocked, or unlabelled) are pooled, and a
   branch joins its pool (``~allow``, ``~block``, ``~none``) when neither its labels nor what follows it differ
   significantly from the pool: both total variation distances stay within a Hoeffding bound.
3. *Judge.* A template's purity is its share of blocked pages among labelled ones, smoothed by ``weight`` pages of
   what the same path shape shows on all hosts, which is itself smoothed by the overall share and counts as one half at
   most. Purity above one half rejects the template, so other hosts can never reject a template alone: it takes
   blocked pages of its own. A rule that fits a page always decides it.

Segments beyond ``max_depth`` levels fold into one, ``**``.

Paths are counted once per host and path before the tree is built. Every level is a few counts (combined before the
shuffle) and joins on the node, so one host with a third of all pages is never gathered in a task.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm.storage import cut

#: Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_DEPTH = 8
MIN_COUNT = 3
ALPHA = 0.05
WEIGHT = 2.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path, else null."""
    out = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _segments(path: Column, max_depth: int) -> Column:
    """Segments after the leading slash; those beyond ``max_depth`` fold into one."""
    parts = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(path, "^/", ""), "/"))
    return F.when(F.size(parts) > max_depth, F.concat(F.slice(parts, 1, max_depth - 1), F.array(F.lit("**")))).otherwise(parts)


def _shape(segment: Column) -> Column:
    return F.regexp_replace(segment, "[0-9]+", "#")


def _generalise(paths: DataFrame, level: int, min_count: int) -> DataFrame:
    """``paths`` with the ``token`` of their segment at ``level`` (null where the path has ended)."""
    here = paths.withColumn("segment", F.get("segments", F.lit(level)))
    node = ["host", "template"]
    names = here.where("segment IS NOT NULL").groupBy(*node, "segment").agg(F.sum("n").alias("c"))
    marked = names.withColumn("named", F.col("c") >= min_count).withColumn("shape", _shape(F.col("segment")))
    shapes = (marked.where("NOT named").groupBy(*node, "shape").agg(F.sum("c").alias("s"))
              .select(*node, "shape", F.when(F.col("s") >= min_count, F.col("shape")).otherwise("*").alias("general")))
    tokens = (marked.join(shapes, [*node, "shape"], "left")
              .select(*node, "segment", F.when(F.col("named"), F.col("segment")).otherwise(F.col("general")).alias("token"),
                      "named"))
    return here.join(tokens, [*node, "segment"], "left")


def _merge(spark: SparkSession, paths: DataFrame, level: int, alpha: float) -> DataFrame:
    """``paths`` with ``token`` replaced by the pool's name for named branches that are like their pool."""
    branch = ["host", "template", "token"]
    label = [("allow", F.sum("allow")), ("block", F.sum("block")), ("none", F.sum(F.col("n") - F.col("allow") - F.col("block")))]
    named = paths.where("named")
    sums = named.groupBy(*branch).agg(*[c.alias(k) for k, c in label])
    sums = sums.withColumn("size", F.col("allow") + F.col("block") + F.col("none")).withColumn(
        "lean", F.when(F.col("allow") + F.col("block") == 0, "none").when(F.col("block") > F.col("allow"), "block").otherwise("allow"))
    pool = ["host", "template", "lean"]
    pools = sums.groupBy(*pool).agg(*[F.sum(k).alias(f"p_{k}") for k in ("allow", "block", "none", "size")],
                                    F.count("*").alias("branches")).where("branches > 1")
    compared = sums.join(pools, pool)
    gap = lambda mine, theirs: F.abs(mine / F.col("size") - theirs / F.col("p_size"))
    compared = compared.withColumn("labels_gap", sum((gap(F.col(k), F.col(f"p_{k}")) for k, _ in label), F.lit(0.0)) / 2)
    compared = cut(spark, compared.select(*branch, "lean", "size", "p_size", "labels_gap"), "branches")
    follow = F.coalesce(_shape(F.get("segments", F.lit(level + 1))), F.lit(""))
    after = (named.groupBy(*branch, follow.alias("follow")).agg(F.sum("n").alias("c"))
             .join(compared.select(*branch, "lean", "size", "p_size"), branch))
    together = after.groupBy(*pool, "follow").agg(F.sum("c").alias("p_c"))
    # What the pool has and the branch has not makes up the rest of the distance: sum over the branch's own of max(0, p - q).
    after = (after.join(together, [*pool, "follow"])
             .groupBy(*branch).agg(F.sum(F.greatest(F.lit(0.0), F.col("c") / F.col("size") - F.col("p_c") / F.col("p_size"))).alias("follow_gap")))
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / F.sqrt("size") + 1 / F.sqrt("p_size"))
    alike = (compared.join(after, branch).where((F.col("labels_gap") <= bound) & (F.col("follow_gap") <= bound))
             .select(*branch, F.concat(F.lit("~"), F.col("lean")).alias("merged")))
    return paths.join(alike, branch, "left").withColumn("token", F.coalesce("merged", "token")).drop("merged")


def template_table(spark: SparkSession, paths: DataFrame, max_depth: int = MAX_DEPTH, min_count: int = MIN_COUNT,
                   alpha: float = ALPHA, weight: float = WEIGHT, most: float = 0.5) -> DataFrame:
    """``host, path, template, purity`` from ``host, path, n, allow, block`` (one row per host and path).

    What other hosts show counts as ``most`` at most.
    """
    paths = paths.withColumn("segments", _segments(F.col("path"), max_depth))
    paths = cut(spark, paths.withColumn("template", F.lit("")).withColumn("plain", F.lit("")), "paths")
    depth = paths.agg(F.max(F.size("segments"))).first()[0] or 0
    keep = ["host", "path", "n", "allow", "block", "segments", "template", "plain"]
    for level in range(depth):
        there = cut(spark, _generalise(paths, level, min_count).withColumn("plain_token", F.col("token")), "level")
        there = _merge(spark, there, level, alpha)
        grown = lambda name, token: F.when(F.col(token).isNull(), F.col(name)).otherwise(F.concat(F.col(name), F.lit("/"), F.col(token)))
        paths = cut(spark, there.withColumn("template", grown("template", "token"))
                    .withColumn("plain", grown("plain", "plain_token")).select(*keep), "paths")
    total = paths.agg(F.sum("allow"), F.sum("block")).first()
    allow, block = total[0] or 0, total[1] or 0
    overall = block / (allow + block) if allow + block else 0.0
    smooth = lambda back: (F.sum("block") + weight * back) / (F.sum("allow") + F.sum("block") + weight)
    everywhere = paths.groupBy("plain").agg(F.least(smooth(F.lit(overall)), F.lit(most)).alias("back"))
    own = ["host", "template"]
    judged = (paths.join(everywhere, "plain").groupBy(*own)
              .agg(smooth(F.sum(F.col("n") * F.col("back")) / F.sum("n")).alias("purity")))
    return paths.join(judged, own).select("host", "path", "template", "purity")


def judge_urls(spark: SparkSession, pages: DataFrame, url_col: str = "url", rules: tuple = RULES,
               threshold: float = 0.5, **tree) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, template, purity`` (input columns of these names are replaced).

    Every row stays. A null url, or one without ``://``, has an empty host and path and is judged like any other.
    Repeated urls count as often as they occur and get one verdict. Without labels nothing is rejected. An empty table
    gives an empty result.
    """
    new = ("host", "path", "rule", "verdict", "template", "purity")
    names = pages.columns
    rows = pages.toDF(*[f"c{i}" for i in range(len(names))])
    url = F.col(f"c{[n.lower() for n in names].index(url_col.lower())}").cast("string")
    rows = rows.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    rows = rows.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    says = lambda v: F.sum(F.coalesce(F.col("by_rule.verdict") == v, F.lit(False)).cast("long"))
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), says("allow").alias("allow"), says("block").alias("block"))
    found = template_table(spark, paths, most=threshold, **tree)
    verdict = F.coalesce("by_rule.verdict", F.when(F.col("purity") > threshold, "block").otherwise("allow"))
    plain = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in new]
    return rows.join(found, ["host", "path"]).select(*plain, "host", "path", F.col("by_rule.rule").alias("rule"),
                                                     verdict.alias("verdict"), "template", "purity")
