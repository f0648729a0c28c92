"""Comparison of stored results: keyed differences, exact cover, referential checks, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import read


def differences(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, was, now, change) of every value that was added, removed or changed; nulls equal nulls."""
    fields = [c for c in before.columns if c not in keys]
    long = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in fields])).alias("v")).select(*keys, "v.*", F.lit(True).alias(f"in_{name}"))
    both = long(before, "was").join(long(after, "now"), [*keys, "field"], "full_outer")
    change = F.when(F.col("in_was").isNull(), "added").when(F.col("in_now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).drop("in_was", "in_now")


def cover(cells: DataFrame, domain: DataFrame) -> DataFrame:
    """Rows that break an exact cover: missing from the cells, or there too often; multiplicities count."""
    columns = domain.columns
    return domain.exceptAll(cells.select(*columns)).withColumn("fault", F.lit("missing")).unionByName(cells.select(*columns).exceptAll(domain).withColumn("fault", F.lit("extra")))


def references(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Children without a parent and parents without a child: one full join of the distinct keys."""
    (c, p), *rest = on.items()
    assert not rest
    left = child.select(F.col(c).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    right = parent.select(F.col(p).alias("key")).distinct().withColumn("known", F.lit(True))
    joined = left.join(right, "key", "full_outer")
    return joined.select("key", F.when(F.col("known").isNull(), "no_parent").when(F.col("rows").isNull(), "no_child").alias("fault"), F.coalesce("rows", F.lit(0)).alias("rows")).filter(F.col("fault").isNotNull())


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def q_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    moved = lambda df, divisor, by: df.withColumn("p_partkey", F.when(F.col("p_partkey") % divisor == 0, F.col("p_partkey") + by).otherwise(F.col("p_partkey")))
    changed = part.withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).when(F.col("p_partkey") % 13 == 0, F.lit(None)).otherwise(F.col("p_size")))
    return differences(moved(part, 17, 10**12), moved(changed, 11, 10**13), ["p_partkey"])


def q_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    moved = items.select("l_orderkey", F.expr("if(l_orderkey % 100 = 3, l_linenumber + 100, l_linenumber)").alias("l_linenumber"), F.explode(F.expr("array_repeat(0, if(l_orderkey % 100 = 5, 2, 1))")))
    return cover(moved, items)


def q_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select(F.expr("if(c_custkey % 10 = 0, -1 - c_custkey, c_custkey)").alias("c_custkey")), {"o_custkey": "c_custkey"})


def q_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(read(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


QUERIES = {"keyed_differences": q_differences, "exact_cover": q_cover, "reference_check": q_references, "duplicate_keys": q_duplicates}
SQL = {
    "keyed_differences": """
        WITH a AS (SELECT p_partkey + CASE WHEN p_partkey % 17 = 0 THEN 1000000000000 ELSE 0 END AS p_partkey, p_brand, p_size FROM part), b AS (SELECT p_partkey + CASE WHEN p_partkey % 11 = 0 THEN 10000000000000 ELSE 0 END AS p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size END AS p_size FROM part),
        j AS (SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, a.p_partkey IS NULL AS fresh, b.p_partkey IS NULL AS gone, a.p_brand AS w1, b.p_brand AS n1, a.p_size::VARCHAR AS w2, b.p_size::VARCHAR AS n2 FROM a FULL JOIN b USING (p_partkey)),
        l AS (SELECT p_partkey, fresh, gone, 'p_brand' AS field, w1 AS was, n1 AS now FROM j UNION ALL SELECT p_partkey, fresh, gone, 'p_size', w2, n2 FROM j)
        SELECT p_partkey, field, was, now, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change FROM l WHERE fresh OR gone OR was IS DISTINCT FROM now
    """,
    "exact_cover": "SELECT l_orderkey, l_linenumber, 'missing' AS fault FROM lineitem WHERE l_orderkey % 100 = 3 UNION ALL SELECT l_orderkey, l_linenumber + 100, 'extra' FROM lineitem WHERE l_orderkey % 100 = 3 UNION ALL SELECT l_orderkey, l_linenumber, 'extra' FROM lineitem WHERE l_orderkey % 100 = 5",
    "reference_check": "WITH c AS (SELECT o_custkey AS key, count(*) AS rows FROM orders GROUP BY 1), p AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN -1 - c_custkey ELSE c_custkey END AS key FROM customer) SELECT coalesce(c.key, p.key) AS key, CASE WHEN p.key IS NULL THEN 'no_parent' ELSE 'no_child' END AS fault, coalesce(rows, 0) AS rows FROM c FULL JOIN p ON c.key = p.key WHERE p.key IS NULL OR c.key IS NULL",
    "duplicate_keys": "SELECT l_partkey, l_suppkey, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
}
