"""URL filters: allow and block rules, and for the rest a path-template tree judged by smoothed labelled purity.

The tree: the path segments of a host form a tree. Level by level, a segment position under a node is variable if it
holds ``MANY`` or more rare values, of fewer than ``SUPPORT`` rows each; its rare values become a wildcard and the others
stay literal branches. A host with fewer than ``MANY * SUPPORT`` rows there and no such position of its own follows the same
place over all hosts, by the counts over all hosts. Rows whose node has fewer than ``MANY`` rows over all hosts leave the
descent with their further segments as they are, as nothing below can be variable; the rest goes down to the
deepest path, in one step as far as no row leaves the way of the others. Sibling branches whose shares of blocked pages do not differ significantly (a
two-proportion test between neighbours in order of share) are merged.

Labels are the verdicts of the rules, on the pages that some rule fits. The purity of a merged template is its share of
blocked pages, smoothed towards that of the same template over all hosts, and that towards the share over all
pages, with ``PRIOR`` pseudo-pages each. A template is rejected (block) if its purity is above one half.

The tree is built over distinct paths of a host with their numbers of rows, which are aggregated before they move; pages meet their
verdict in one join at the end, in which hot paths are broadcast. Siblings of equal share are pooled before the
test, so a window holds the distinct shares under a parent, not its templates.

Edge cases: a null URL or one without ``://`` has empty host and path, a node of its own. Rows that repeat
a page_id each get a row. An empty table gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, durable, join_small, join_unique, name, table

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Levels that are taken one by one before steps follow the branching: that needs more jobs a level, and most paths end before.
SHALLOW = 6
MANY, SUPPORT, PRIOR, Z = 8, 4, 5.0, 1.96


def parsed(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """id, host and path of each row."""
    url = name(url_col)
    at = F.instr(F.coalesce(F.col(url), F.lit("")), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    cut = pages.select(F.col(name(id_col)).alias("id"), rest.alias("rest")).withColumn("raw", F.regexp_extract("rest", r"\A[^/?#]*", 0))
    after = F.expr("substring(rest, length(raw) + 1)")
    return cut.select("id", ascii_lower(F.col("raw")).alias("host"), F.regexp_extract(after, r"\A[^?#]*", 0).alias("path"))


def by_rules(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones override
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def ahead(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the nodes at which some row leaves the way of the others, and all other rows, moved on to where that happens or to their end.

    The way of a node is the greatest of its rows' further segments. Up to the first place where a row departs from it every
    node has one branch, which no position with ``MANY`` values can be, so all rows move there in one step, however deep it is.
    """
    on = F.zip_with("rest", "way", lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(on, F.lit(False)), F.lit(0)) - 1, F.size(on)).cast("int")
    along = durable(join_small(rows, nodes.select("node", "way"), ["node"]).withColumn("shared", shared).drop("way"))
    parting = durable(along.groupBy("node").agg(F.min(F.when(F.col("shared") < F.size("rest"), F.col("shared"))).alias("parting")))
    met = join_small(along, parting, ["node"])
    step = F.least(F.col("parting"), F.size("rest"))  # of two, the one that is not null
    moved = met.filter("parting is null or parting > 0").withColumn("step", step)
    node = F.concat_ws("/", "node", F.array_join(F.slice("rest", F.lit(1), F.col("step")), "/"))
    moved = moved.withColumn("node", node).withColumn("rest", F.slice("rest", F.col("step") + 1, F.size("rest"))).drop("shared", "parting", "step")
    return met.filter("parting = 0").drop("shared", "parting"), moved


def branched(rows: DataFrame) -> DataFrame:
    """Rows moved on by one segment, which becomes a wildcard where it is a rare value of a variable position."""
    segment = F.element_at("rest", 1)
    counts = durable(rows.groupBy("host", "node", segment.alias("segment")).agg(F.sum("n").alias("n")))
    total = counts.groupBy("node", "segment").agg(F.sum("n").alias("n"))
    rare = F.count_if(F.col("n") < SUPPORT) >= MANY
    # a host decides by itself if it has a variable position or rows enough to show that it has none
    own = counts.groupBy("host", "node").agg(rare.alias("own"), F.sum("n").alias("rows")).filter(F.col("own") | (F.col("rows") >= MANY * SUPPORT)).drop("rows")
    common = total.groupBy("node").agg(rare.alias("common")).filter("common")
    known = rows.withColumn("segment", segment)
    wild = F.lit(False)
    if not own.filter("own").select("node").unionByName(common.select("node")).isEmpty():
        literal = F.col("n") >= SUPPORT
        own_literal = counts.filter(literal).join(own.filter("own"), ["host", "node"], "left_semi").select("host", "node", "segment", F.lit(True).alias("own_literal"))
        common_literal = total.filter(literal).join(common, "node", "left_semi").select("node", "segment", F.lit(True).alias("common_literal"))
        for side, keys in ((own, ["host", "node"]), (common, ["node"]), (own_literal, ["host", "node", "segment"]), (common_literal, ["node", "segment"])):
            known = join_small(known, side, keys, "left")
        wild = F.when(F.col("own").isNotNull(), F.col("own") & F.col("own_literal").isNull()).otherwise(F.col("common").isNotNull() & F.col("common_literal").isNull())
    node = F.concat("node", F.lit("/"), F.when(wild, F.lit("*")).otherwise(F.col("segment")))
    return known.withColumn("node", node).withColumn("rest", F.slice("rest", F.lit(2), F.size("rest"))).select(*rows.columns)


def templates(rows: DataFrame) -> DataFrame:
    """Adds template, the path with variable segments as wildcards, and parent, the template without its last segment.

    A row counts ``n`` times, or once if there is no such column. Steps follow the branching of the paths, not their depth.
    """
    rows = rows if "n" in rows.columns else rows.withColumn("n", F.lit(1).cast("long"))
    segments = F.split("path", "/", -1)
    active = durable(rows.withColumn("node", F.lit("")).withColumn("rest", F.slice(segments, F.lit(2), F.size(segments))))
    columns, done, level = active.columns, [], 0
    while True:
        done.append(active.filter(F.size("rest") == 0))
        going = active.filter(F.size("rest") > 0)
        deep = level >= SHALLOW
        sums = [F.sum("n").alias("n"), *([F.max("rest").alias("way")] if deep else [])]
        nodes = durable(going.groupBy("node").agg(*sums).filter(F.col("n") >= MANY).withColumn("crowded", F.lit(True)))
        marked = join_small(going, nodes.select("node", "crowded"), ["node"], "left")
        done.append(marked.filter("crowded is null").withColumn("node", F.concat_ws("/", "node", F.array_join("rest", "/"))).select(*columns))
        if nodes.isEmpty():
            break
        parted, moved = marked.filter("crowded").drop("crowded"), None
        if deep:
            parted, moved = ahead(parted, nodes)
        stepped = branched(parted).select(*columns)
        active = durable(stepped if moved is None else stepped.unionByName(moved.select(*columns)))
        level += 1
    every = durable(reduce(DataFrame.unionByName, [part.select(*columns) for part in done]))
    return every.drop("rest").withColumnRenamed("node", "template").withColumn("parent", F.regexp_replace("template", r"/[^/]*\z", ""))


def judged(rows: DataFrame) -> DataFrame:
    """(host, template, purity, branch) of each template, from rows with host, parent, template, label (1 blocked, 0 allowed, null) and, if they count more than once, n."""
    weight = F.col("n") if "n" in rows.columns else F.lit(1)
    labelled = F.when(F.col("label").isNotNull(), weight).otherwise(0)
    leaf = rows.groupBy("host", "parent", "template").agg(F.sum(labelled).alias("n"), F.coalesce(F.sum(F.col("label") * weight), F.lit(0)).alias("bad"))
    leaf = durable(leaf.withColumn("share", F.when(F.col("n") > 0, F.col("bad") / F.col("n"))))
    siblings = Window.partitionBy("host", "parent").orderBy("share")
    pooled = (F.col("bad") + F.lag("bad").over(siblings)) / (F.col("n") + F.lag("n").over(siblings))
    wide = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.lag("n").over(siblings)))
    apart = F.coalesce((F.col("share") - F.lag("share").over(siblings)) > Z * wide, F.lit(False))
    shares = leaf.filter("n > 0").groupBy("host", "parent", "share").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    seen = shares.withColumn("apart", apart.cast("int"))
    branch = seen.withColumn("branch", F.sum("apart").over(siblings.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("host", "parent", "branch")
    merged = branch.select("host", "parent", "share", "branch", F.sum("n").over(whole).alias("n"), F.sum("bad").over(whole).alias("bad"))
    overall = leaf.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select(F.when(F.col("n") > 0, F.col("bad") / F.col("n")).otherwise(F.lit(0.0)).alias("overall"))
    rate = overall.first()["overall"]
    across = leaf.groupBy("template").agg(((F.sum("bad") + PRIOR * F.lit(rate)) / (F.sum("n") + PRIOR)).alias("across"))
    every = join_unique(leaf.select("host", "parent", "template", "share"), merged, ["host", "parent", "share"], "left")
    every = join_unique(every, across, ["template"])
    return every.select("host", "template", ((F.coalesce("bad", F.lit(0)) + PRIOR * F.col("across")) / (F.coalesce("n", F.lit(0)) + PRIOR)).alias("purity"), "branch")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict, template, purity."""
    rule, verdict = by_rules(rules)
    rows = durable(parsed(pages, id_col, url_col))
    ruled = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("rule", rule).withColumn("ruling", verdict)
    paths = templates(ruled).withColumn("label", F.when(F.col("ruling").isNotNull(), (F.col("ruling") == "block").cast("int")))
    purity = durable(judged(paths).select("host", "template", "purity"))
    method = F.when(F.col("purity") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    known = join_unique(paths, purity, ["host", "template"]).select("host", "path", "rule", F.coalesce("ruling", method).alias("verdict"), "template", "purity")
    return join_unique(rows, durable(known), ["host", "path"]).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "template", "purity")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op8_urls": op8_urls}
SQL: dict[str, str] = {}
