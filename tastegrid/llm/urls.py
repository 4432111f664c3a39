"""URL filters by a tree of path templates per host.

Every URL is a host and a path of segments. Level by level, segments become template segments: values
that hold a digit are generalised by shape, and a value that too few URLs have under its parent becomes a
wildcard with all others that are as rare; what is frequent enough to have a purity of its own stays a branch,
however many values a position has. Sibling branches whose labelled purity cannot be told apart are merged
into one. The tree goes on as long as a node holds different paths; there is no depth at which it ends.
A node's purity is smoothed by its parent's, up to the share of blocked labels
of all, so that a template with few labels follows its branch. A URL is blocked when the purity of its
deepest template reaches the threshold.

Labels come from the rules: a URL that a rule decides is a labelled example for its template.
Everything is DataFrame code: one row per URL, sums per node, joins by (host, template).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tastegrid.session import stage

#: (domain or part of one, path prefix, verdict)
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
#: URLs that a value needs under its parent to be a branch of its own.
SUPPORT = 5
#: Purities that are told apart before siblings are compared; what is compared is at most so many.
GRADES = 200
#: Labels that the parent's purity counts for.
PRIOR = 4.0
#: Smoothed share of blocked labels from which a template is blocked: a branch without labels of its own
#: is blocked only where its host hardly has anything else.
BLOCKED = 0.8
#: Siblings merge when their purities differ by less than this many standard errors.
ALIKE = 1.0


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(_col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for null and for what is no URL."""
    return F.regexp_extract(F.coalesce(_col(url), F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, and its path prefix."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for dom, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == dom) | host.endswith("." + dom)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(dom + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> Column:
    """All segments of the path, each with digits as ``#`` by shape."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    shape = lambda s: F.regexp_replace(F.regexp_replace(
        s, r"(?i)\b(?=[0-9a-f-]*[0-9])[0-9a-f]{8,}(?:-[0-9a-f]+)*\b", "<hex>"), r"[0-9]+", "<n>")
    return F.when(F.length(path) > 1, F.transform(parts, shape)).otherwise(F.array().cast("array<string>"))


def _levelled(open_: DataFrame, level: int) -> DataFrame:
    """Shapes that go on below their node ``t``, with the node of the next level."""
    seg = F.get("segments", F.lit(level - 1))
    values = open_.groupBy("host", F.col("t").alias("_above"), seg.alias("_seg")).agg(
        F.sum("_rows").alias("rows"), F.sum("_labels").alias("n"), F.sum("_blocked").alias("b"))
    named = values.withColumn("_name", F.when(F.col("rows") < SUPPORT, F.lit("*")).otherwise(F.col("_seg")))
    sums = named.groupBy("host", "_above", "_name").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    # siblings of nearly the same purity are one grade; grades in order of purity are one branch until one
    # stands apart. Without labels there is no purity to compare, and a branch stays its own.
    p = (F.col("b") + 0.5) / (F.col("n") + 1.0)
    graded = sums.withColumn("_grade", F.when(F.col("n") > 0, F.round(p * GRADES).cast("int")))
    grades = graded.filter("_grade IS NOT NULL").groupBy("host", "_above", "_grade").agg(
        F.sum("n").alias("n"), F.sum("b").alias("b"), F.min("_name").alias("_first")).withColumn("_p", p)
    order = Window.partitionBy("host", "_above").orderBy("_grade")
    error = F.sqrt(F.col("_p") * (1 - F.col("_p")) / (F.col("n") + 1)
                   + F.lag("_p").over(order) * (1 - F.lag("_p").over(order)) / (F.lag("n").over(order) + 1))
    apart = F.coalesce(F.col("_p") - F.lag("_p").over(order) > ALIKE * error, F.lit(True))
    merged = (
        grades.withColumn("_new", apart).withColumn("_branch", F.sum(F.col("_new").cast("int")).over(order))
        .withColumn("_branch", F.min("_first").over(Window.partitionBy("host", "_above", "_branch")))
        .select("host", "_above", "_grade", "_branch")
    )
    branches = graded.join(merged, ["host", "_above", "_grade"], "left").withColumn(
        "_branch", F.coalesce("_branch", "_name"))
    names = named.select("host", "_above", "_seg", "_name").join(
        branches.select("host", "_above", "_name", "_branch"), ["host", "_above", "_name"])
    names = names.select(F.col("host").alias("_h"), "_above", "_seg", F.concat("_above", F.lit("/"), "_branch").alias("_t"))
    return open_.join(names, (F.col("host") == F.col("_h")) & (F.col("t") == F.col("_above")) & (seg == F.col("_seg"))).select(
        "host", "segments", "_rows", "_labels", "_blocked", F.col("_t").alias("t"), "purity")


def _judged(shapes: DataFrame) -> DataFrame:
    """Shapes with the purity of their node ``t``, smoothed by the purity above, and the node's distinct shapes."""
    node = shapes.groupBy(F.col("host").alias("_h"), F.col("t").alias("_t")).agg(
        F.sum("_labels").alias("_n"), F.sum("_blocked").alias("_b"), F.count(F.lit(1)).alias("_shapes"))
    return shapes.join(node, (F.col("host") == F.col("_h")) & (F.col("t") == F.col("_t"))).withColumn(
        "purity", (F.col("_b") + PRIOR * F.col("purity")) / (F.col("_n") + PRIOR)).drop("_h", "_t", "_n", "_b")


def filtered(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every row.

    A null URL, or one without ``://``, has an empty host and path and is judged like any other. Repeated rows
    count as often as they stand. Without any label nothing is blocked.
    """
    host, path = host_of(url_col), path_of(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says)
    # one row per distinct host and shape of path goes through the tree
    rows = stage(rows.withColumn("segments", _segments(F.col("path"))), "urls")
    shapes = rows.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.col("says").isNotNull().cast("long")).alias("_labels"),
        F.sum((F.coalesce("says", F.lit("")) == "block").cast("long")).alias("_blocked"))
    # purity from the top: all, host, then level by level, as far down as a node holds different paths
    total = shapes.agg(F.sum("_labels"), F.sum("_blocked")).first()
    top = (total[1] or 0) / total[0] if total[0] else 0.0
    level, done = 0, None
    now = stage(_judged(shapes.withColumn("t", F.lit("")).withColumn("purity", F.lit(float(top)))), "level")
    while True:
        goes_on = (F.size("segments") > level) & (F.col("_shapes") > 1)
        ended = now.filter(~goes_on).select("host", "segments", "t", "purity")
        done = ended if done is None else done.unionByName(ended)
        open_ = now.filter(goes_on)
        if open_.isEmpty():
            break
        level += 1
        now = stage(_judged(_levelled(open_.drop("_shapes"), level)), "level")
    tree = stage(done.select(F.col("host").alias("_h"), F.col("segments").alias("_s"), F.col("t").alias("template"), "purity"), "tree")
    verdict = F.coalesce("says", F.when(F.col("purity") >= BLOCKED, F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(tree, (F.col("host") == F.col("_h")) & (F.col("segments") == F.col("_s"))).select(
        "id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op3_url_filters(spark, folder: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return filtered(spark.read.parquet(f"{folder}/pages.parquet")).select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template", "purity")
