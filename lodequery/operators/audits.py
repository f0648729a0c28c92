"""Audits of stored runs: agreement within a tolerance, named checks, tagged selections, exactly-once delivery, first differences.

Each audit is one aggregate or one equi-join on the audited key, so it scales with the rows audited; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import LOG, OUTCOMES, log, outcomes, read
from ..functions.hashing import salted
from ..functions.spelling import common_prefix


def agreement(base: DataFrame, control: DataFrame, keys: list[str], value: str, atol: float, rtol: float) -> DataFrame:
    """(keys, verdict): agrees if ``|new - old| <= atol + rtol * |old|``; else differs, missing or unexpected. Two nulls agree, a null and a number differ."""
    old = base.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    new = control.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    close = F.abs(F.col("_new") - F.col("_old")) <= atol + rtol * F.abs(F.col("_old"))
    same = F.coalesce(close, F.col("_old").isNull() & F.col("_new").isNull())
    verdict = F.when(F.col("_in_new").isNull(), "missing").when(F.col("_in_old").isNull(), "unexpected").when(same, "agrees").otherwise("differs")
    return old.join(new, keys, "full_outer").select(*keys, verdict.alias("verdict"))


def named_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check, failed, passed): one row for each rule over all rows, in one aggregate. An unknown result fails."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("failed")) for name in rules]))
    return counts.select(rows.alias("r")).select("r.check", "r.failed", (F.col("r.failed") == 0).alias("passed"))


def tagged(selections: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, tags): the union of the selections, each key once with the names of those that hold it, in order."""
    named = [df.select(key, F.lit(tag).alias("tag")) for tag, df in selections.items()]
    return reduce(DataFrame.unionByName, named).groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))


def snapshots(df: DataFrame, size: str, item: str, salt: str) -> DataFrame:
    """(size, item, items): of each size the item with the lowest salted hash, by a partial minimum."""
    return df.groupBy(size).agg(F.min(F.struct(salted(salt, F.col(item)).alias("h"), F.col(item))).alias("_first"), F.count(F.lit(1)).alias("items")).select(size, F.col("_first")[item].alias(item), "items")


def exactly_once(sent: DataFrame, stages: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, a count for each stage, verdict): every sent key must be met once in each stage; the first stage that fails is named.

    Stages are counted before they are joined, so a key met very often is one row.
    """
    out = sent.select(key).distinct()
    for name, df in stages.items():
        out = out.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    out = out.fillna(0, list(stages))
    verdict = F.lit("accepted")
    for name in reversed(stages):
        verdict = F.when(F.col(name) == 0, f"{name}_missing").when(F.col(name) > 1, f"{name}_repeated").otherwise(verdict)
    return out.withColumn("verdict", verdict)


def first_difference(left: Column, right: Column) -> tuple[Column, Column]:
    """(place of the first differing element from 1 or null, status): nothing_yet without a left element, same_so_far if the left one is a prefix."""
    shared = common_prefix(left, right)
    differs = (shared < F.size(left)) & (shared < F.size(right))
    longer = (shared == F.size(right)) & (shared < F.size(left))
    status = F.when(F.size(left) == 0, "nothing_yet").when(differs | longer, "differs").when(F.size(left) == F.size(right), "same").otherwise("same_so_far")
    return F.when((F.size(left) > 0) & (differs | longer), shared + 1), status


def arm_differences(df: DataFrame, parent: str, arm: str, value: str, first: str, second: str) -> DataFrame:
    """(parent, first, second, difference) of the sums of two arms; a parent without either arm is not compared."""
    of = lambda name: F.sum(F.when(F.col(arm) == name, F.col(value)))
    sums = df.filter(F.col(arm).isin(first, second)).groupBy(parent).agg(of(first).alias("first"), of(second).alias("second"))
    return sums.filter("first is not null and second is not null").withColumn("difference", F.col("second") - F.col("first"))


def incomplete(df: DataFrame, parent: str, view: str, views: tuple[str, ...]) -> DataFrame:
    """(parent, missing): parents that lack one of the views, with those they lack in the order given."""
    have = df.groupBy(parent).agg(F.collect_set(view).alias("_have"))
    lack = F.array_except(F.array(*map(F.lit, views)), F.col("_have"))
    return have.withColumn("missing", F.array_join(lack, ",")).filter(F.col("missing") != "").drop("_have")


def split_faults(whole: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, fault, parts): keys of the whole in no part (uncovered) or in several (shared), and keys of a part that the whole lacks (foreign)."""
    tags = [whole.select(key, F.lit(None).cast("string").alias("part"))] + [df.select(key, F.lit(name).alias("part")) for name, df in parts.items()]
    met = reduce(DataFrame.unionByName, tags).groupBy(key).agg(F.count_if(F.col("part").isNull()).alias("n"), F.sort_array(F.collect_set("part")).alias("_parts"))
    fault = F.when(F.col("n") == 0, "foreign").when(F.size("_parts") == 0, "uncovered").when(F.size("_parts") > 1, "shared")
    return met.select(key, fault.alias("fault"), F.array_join("_parts", ",").alias("parts")).filter(F.col("fault").isNotNull())


def longest_choice(df: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """(group, first, longest): the first item and the longest one, ties to the later."""
    return df.groupBy(group).agg(F.min(order).alias("first"), F.max(F.struct(length, order)).alias("_long")).select(group, "first", F.col("_long")[order].alias("longest"))


def cold_and_warm(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, cold, warm_n, warm_sum): the first value of each group against the rest, by a partial minimum."""
    known = df.filter(F.col(value).isNotNull())
    rows = known.groupBy(*keys).agg(F.min(F.struct(*order, value)).alias("_first"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return rows.select(*keys, F.col("_first")[value].alias("cold"), (F.col("n") - 1).alias("warm_n"), (F.col("total") - F.col("_first")[value]).alias("warm_sum"))


def starts(df: DataFrame, keys: list[str], order: list[str], state: str, wanted: str) -> DataFrame:
    """(keys, starts, kept): rows of the wanted state that follow another state or nothing, and the rest of its rows."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    flagged = df.withColumn("_start", (F.col(state) == wanted) & ~F.coalesce(before == wanted, F.lit(False)))
    return flagged.groupBy(*keys).agg(F.count_if("_start").alias("starts"), F.count_if((F.col(state) == wanted) & ~F.col("_start")).alias("kept"))


def levels(df: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """(level, keys, n, hits): counts at several levels at once by grouping sets; a key outside a level is null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    name = F.concat_ws("+", *[F.when(F.grouping(c) == 0, c) for c in columns])
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(name.alias("level"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("hits"))


def q_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    moved = F.expr("case when o_orderkey % 5 = 0 then price * 1.00001 when o_orderkey % 7 = 0 then price * 1.1 when o_orderkey % 11 = 0 then null else price end")
    control = orders.withColumn("price", moved).filter("o_orderkey % 13 <> 0").withColumn("o_orderkey", F.expr("if(o_orderkey % 17 = 0, -o_orderkey, o_orderkey)"))
    return agreement(orders, control, ["o_orderkey"], "price", 0.01, 1e-4)


def q_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "quantity_positive": F.col("l_quantity") > 0,
        "discount_in_range": F.col("l_discount").between(0, 0.05),
        "tax_below_discount": F.col("l_tax") < F.col("l_discount"),
        "line_number_small": F.col("l_linenumber") <= 5,
    }
    return named_checks(read(spark, sf_dir, "lineitem"), rules)


def q_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return tagged({"urgent": orders.filter("o_orderpriority = '1-URGENT'"), "open": orders.filter("o_orderstatus = 'O'"), "large": orders.filter("o_totalprice > 200000")}, "o_orderkey")


def q_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(read(spark, sf_dir, "part"), "p_size", "p_partkey", "snapshot")


def q_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return exactly_once(read(spark, sf_dir, "orders"), {"acknowledged": items.filter("l_linenumber = 1"), "result": items.filter("l_returnflag = 'R'")}, "o_orderkey")


def q_first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", "").alias("w"))
    reference = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("w").alias("r"))
    place, status = first_difference(F.col("w"), F.col("r"))
    return part.join(reference, "p_partkey").select("p_partkey", place.alias("place"), status.alias("status"))


def q_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    return arm_differences(items, "l_orderkey", "l_returnflag", "q", "R", "N")


def q_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incomplete(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ("R", "A", "N"))


def q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    low, high = orders.filter("o_totalprice < 150000"), orders.filter("o_totalprice between 140000 and 300000")
    return split_faults(orders.filter("o_orderkey % 19 <> 0"), {"low": low, "high": high}, "o_orderkey")


def q_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").withColumn("length", F.length("o_orderpriority"))
    return longest_choice(orders, "o_custkey", "o_orderkey", "length")


def q_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cold_and_warm(log(spark, sf_dir), ["session", "ev"], ["utc_us", "event_id"], "k")


def q_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starts(log(spark, sf_dir), ["session"], ["utc_us", "event_id"], "ev", "click")


def q_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(outcomes(spark, sf_dir), [["environment", "stratum"], ["environment"], ["outcome"], []], "first")


QUERIES = {
    "tolerance_agreement": q_agreement,
    "named_checks": q_checks,
    "tagged_selections": q_tagged,
    "size_snapshots": q_snapshots,
    "exactly_once": q_once,
    "first_difference": q_first_difference,
    "arm_differences": q_arms,
    "incomplete_parents": q_incomplete,
    "split_faults": q_split,
    "longest_choice": q_longest,
    "cold_and_warm": q_cold,
    "state_starts": q_starts,
    "level_counts": q_levels,
}
SQL = {
    "tolerance_agreement": """
        WITH a AS (SELECT o_orderkey, o_totalprice::DOUBLE AS p FROM orders),
        b AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN p * 1.00001::DOUBLE WHEN o_orderkey % 7 = 0 THEN p * 1.1::DOUBLE WHEN o_orderkey % 11 = 0 THEN NULL ELSE p END AS q FROM a WHERE o_orderkey % 13 <> 0)
        SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
               CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'unexpected' WHEN abs(q - p) <= 0.01::DOUBLE + 0.0001::DOUBLE * abs(p) OR (p IS NULL AND q IS NULL) THEN 'agrees' ELSE 'differs' END AS verdict
        FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
    """,
    "named_checks": """
        WITH c AS (SELECT 'quantity_positive' AS check, count(*) FILTER ((l_quantity > 0) IS NOT TRUE) AS failed FROM lineitem
        UNION ALL SELECT 'discount_in_range', count(*) FILTER ((l_discount BETWEEN 0 AND 0.05) IS NOT TRUE) FROM lineitem
        UNION ALL SELECT 'tax_below_discount', count(*) FILTER ((l_tax < l_discount) IS NOT TRUE) FROM lineitem
        UNION ALL SELECT 'line_number_small', count(*) FILTER ((l_linenumber <= 5) IS NOT TRUE) FROM lineitem)
        SELECT *, failed = 0 AS passed FROM c
    """,
    "tagged_selections": """
        WITH t AS (SELECT o_orderkey, 'urgent' AS tag FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 'open' FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'large' FROM orders WHERE o_totalprice > 200000)
        SELECT o_orderkey, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM t GROUP BY 1
    """,
    "size_snapshots": "SELECT p_size, arg_min(p_partkey, sha256('snapshot' || chr(10) || p_partkey)) AS p_partkey, count(*) AS items FROM part GROUP BY 1",
    "exactly_once": """
        WITH a AS (SELECT l_orderkey, count(*) FILTER (l_linenumber = 1) AS acknowledged, count(*) FILTER (l_returnflag = 'R') AS result FROM lineitem GROUP BY 1),
        j AS (SELECT o_orderkey, coalesce(acknowledged, 0) AS acknowledged, coalesce(result, 0) AS result FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN a ON l_orderkey = o_orderkey)
        SELECT *, CASE WHEN acknowledged = 0 THEN 'acknowledged_missing' WHEN acknowledged > 1 THEN 'acknowledged_repeated' WHEN result = 0 THEN 'result_missing' WHEN result > 1 THEN 'result_repeated' ELSE 'accepted' END AS verdict FROM j
    """,
    "first_difference": """
        WITH w AS (SELECT p_partkey, string_split(p_name, '') AS w FROM part),
        j AS (SELECT a.p_partkey, a.w AS x, b.w AS y, least(len(a.w), len(b.w)) AS m FROM w a JOIN w b ON b.p_partkey = a.p_partkey + 1),
        s AS (SELECT *, coalesce(list_min(list_filter(range(1, m + 1), lambda i: x[i] <> y[i])) - 1, m) AS shared FROM j)
        SELECT p_partkey, CASE WHEN shared < m OR len(x) > len(y) THEN shared + 1 END AS place, CASE WHEN shared < m OR len(x) > len(y) THEN 'differs' WHEN len(x) = len(y) THEN 'same' ELSE 'same_so_far' END AS status FROM s
    """,
    "arm_differences": """
        WITH s AS (SELECT l_orderkey, sum(l_quantity::BIGINT) FILTER (l_returnflag = 'R')::BIGINT AS first, sum(l_quantity::BIGINT) FILTER (l_returnflag = 'N')::BIGINT AS second FROM lineitem GROUP BY 1)
        SELECT *, second - first AS difference FROM s WHERE first IS NOT NULL AND second IS NOT NULL
    """,
    "incomplete_parents": """
        WITH h AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS have FROM lineitem GROUP BY 1)
        SELECT l_orderkey, array_to_string(list_filter(['R', 'A', 'N'], lambda v: NOT list_contains(have, v)), ',') AS missing FROM h WHERE NOT list_has_all(have, ['R', 'A', 'N'])
    """,
    "split_faults": """
        WITH t AS (SELECT o_orderkey, o_orderkey % 19 <> 0 AS whole, o_totalprice < 150000 AS low, o_totalprice BETWEEN 140000 AND 300000 AS high FROM orders)
        SELECT o_orderkey, CASE WHEN NOT whole THEN 'foreign' WHEN low THEN 'shared' ELSE 'uncovered' END AS fault, CASE WHEN low AND high THEN 'high,low' WHEN low THEN 'low' WHEN high THEN 'high' ELSE '' END AS parts
        FROM t WHERE (NOT whole AND (low OR high)) OR (whole AND low = high)
    """,
    "longest_choice": "SELECT o_custkey, min(o_orderkey) AS first, arg_max(o_orderkey, (length(o_orderpriority), o_orderkey)) AS longest FROM orders GROUP BY 1",
    "cold_and_warm": f"WITH {LOG} SELECT session, ev, arg_min(k, (utc_us, event_id)) AS cold, count(*) - 1 AS warm_n, (sum(k) - arg_min(k, (utc_us, event_id)))::BIGINT AS warm_sum FROM log WHERE k IS NOT NULL GROUP BY ALL",
    "state_starts": f"""
        WITH {LOG}, f AS (SELECT session, ev, lag(ev) OVER (PARTITION BY session ORDER BY utc_us, event_id) AS before FROM log)
        SELECT session, count(*) FILTER (ev = 'click' AND before IS DISTINCT FROM 'click') AS starts, count(*) FILTER (ev = 'click' AND before = 'click') AS kept FROM f GROUP BY 1
    """,
    "level_counts": f"""
        WITH {OUTCOMES} SELECT environment, stratum, outcome, concat_ws('+', CASE WHEN grouping(environment) = 0 THEN 'environment' END, CASE WHEN grouping(stratum) = 0 THEN 'stratum' END, CASE WHEN grouping(outcome) = 0 THEN 'outcome' END) AS level,
               count(*) AS n, sum(first)::BIGINT AS hits
        FROM outcomes GROUP BY GROUPING SETS ((environment, stratum), (environment), (outcome), ())
    """,
}
