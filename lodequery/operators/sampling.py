"""Hash-stable partitions, stratified sampling with caps, allocations, top-k and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import OUTCOMES, outcomes, read
from ..functions.hashing import named_share, padded_id, salted, share

PARTITIONS = {"train": 0.7, "calibration": 0.1, "development": 0.1, "test": 0.1}


def partitioned(df: DataFrame, group: str, salt: str, weights: dict[str, float] = PARTITIONS) -> DataFrame:
    """Adds partition: all rows of a group share the name that the hash of the group draws."""
    return df.withColumn("partition", named_share(share(salted(salt, F.col(group))), weights))


def merged_by_fingerprint(df: DataFrame, group: str, fingerprint: str) -> DataFrame:
    """Adds group_of: rows that share a fingerprint take the first group by name; null fingerprints keep theirs. Not transitive.

    The first group of a fingerprint is aggregated before it moves, and rows without one are not shuffled.
    """
    known = df.filter(F.col(fingerprint).isNotNull())
    first = known.groupBy(fingerprint).agg(F.min(group).alias("group_of"))
    shared = known.join(first, fingerprint).select(*df.columns, "group_of")
    return shared.unionByName(df.filter(F.col(fingerprint).isNull()).withColumn("group_of", F.col(group)))


def round_robin(df: DataFrame, group: str, stratum: str, item: str, cap: int, salt: str) -> DataFrame:
    """At most ``cap`` items of each group: one of each stratum a round, strata in ascending order, items by salted hash."""
    within = Window.partitionBy(group, stratum).orderBy(salted(salt, F.col(group), F.col(stratum), F.col(item)), item)
    turns = df.withColumn("round", F.row_number().over(within))
    # of a stratum, rounds beyond the cap cannot be taken: they are dropped before the second sort
    order = Window.partitionBy(group).orderBy("round", stratum)
    return turns.filter(F.col("round") <= cap).withColumn("taken", F.row_number().over(order)).filter(F.col("taken") <= cap)


def largest_remainder(counts: DataFrame, name: str, size: str, seats: int, least: int = 0) -> DataFrame:
    """Seats in proportion to size with a minimum each; what is left goes to the largest remainders, ties by name."""
    whole = Window.partitionBy()
    floor = F.least(F.col(size), F.lit(least)).cast("bigint")
    based = counts.withColumn("base", floor).withColumn("free", F.lit(seats) - F.sum("base").over(whole)).withColumn("total", F.sum(F.col(size) - F.col("base")).over(whole))
    exact = based.withColumn("product", F.col("free") * (F.col(size) - F.col("base"))).withColumn("part", F.expr("product div total")).withColumn("rest", F.expr("product % total"))
    left = exact.withColumn("left", F.col("free") - F.sum("part").over(whole)).withColumn("turn", F.row_number().over(Window.orderBy(F.desc("rest"), name)))
    return left.select(name, size, (F.col("base") + F.col("part") + (F.col("turn") <= F.col("left")).cast("int")).cast("bigint").alias("seats"))


def first_by_hash(df: DataFrame, keys: list[str], item: str, k: int, salt: str, separator: str = "|") -> DataFrame:
    """The first ``k`` items of each group in a salted hash order."""
    order = Window.partitionBy(*keys).orderBy(salted(salt, F.col(item), separator=separator), item)
    return df.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= k)


def shift_grid(n: int, spark: SparkSession) -> DataFrame:
    """The n x n cells (assignment, order) of cyclic shifts, the identity first, the rest in hash order."""
    side = spark.range(n)
    grid = side.select(F.col("id").alias("a")).join(side.select(F.col("id").alias("p")), F.lit(True))
    identity = (F.col("a") == 0) & (F.col("p") == 0)
    kind = F.when(identity, "identity").when(F.col("p") == 0, "assignment_only").when(F.col("a") == 0, "list_order_only").otherwise("crossed")
    return grid.select("a", "p", kind.alias("kind"), ((F.col("a") + F.col("p")) % n).alias("offered"), salted("grid", F.col("a"), F.col("p")).alias("digest"))


def q_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioned(outcomes(spark, sf_dir), "environment", "parts/1").groupBy("environment", "partition").agg(F.count(F.lit(1)).alias("n"))


def q_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_robin(outcomes(spark, sf_dir), "environment", "stratum", "parent", 64, "sample/1").select("environment", "stratum", "parent", F.col("taken").cast("bigint").alias("taken"))


def q_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest_remainder(outcomes(spark, sf_dir).groupBy("environment").agg(F.count(F.lit(1)).alias("n")), "environment", "n", 300, 10)


def q_first_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by_hash(outcomes(spark, sf_dir), ["stratum", "outcome"], "parent", 5, "audit/1").select("stratum", "outcome", "parent", F.col("turn").cast("bigint").alias("turn"))


def q_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.length("text") > 40, F.md5("text")).alias("fingerprint"))
    return merged_by_fingerprint(docs, "source", "fingerprint").groupBy("source", "group_of").agg(F.count(F.lit(1)).alias("n"))


def q_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shift_grid(6, spark)


def q_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded ids in their ordinal order, and content ids of the texts."""
    ids = read(spark, sf_dir, "benchmark").select("item_id", padded_id("obj_", F.col("item_id")).alias("object_id"), F.concat(F.lit("cmd_"), F.substring(F.sha2("text", 256), 1, 16)).alias("command_id"))
    return ids.withColumn("ordinal", F.row_number().over(Window.orderBy("object_id")).cast("bigint"))


QUERIES = {"hash_partitions": q_partitions, "round_robin_sample": q_round_robin, "largest_remainder": q_remainder, "first_by_hash": q_first_by_hash, "fingerprint_groups": q_merge, "shift_grid": q_grid, "padded_ids": q_ids}
_u = "('0x' || substr(sha256('parts/1' || chr(10) || environment), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
SQL = {
    "hash_partitions": f"WITH {OUTCOMES} SELECT environment, CASE WHEN {_u} < 0.7 THEN 'train' WHEN {_u} < 0.8 THEN 'calibration' WHEN {_u} < 0.9 THEN 'development' ELSE 'test' END AS partition, count(*) AS n FROM outcomes GROUP BY ALL",
    "round_robin_sample": f"""
        WITH {OUTCOMES}, t AS (SELECT *, row_number() OVER (PARTITION BY environment, stratum ORDER BY sha256('sample/1' || chr(10) || environment || chr(10) || stratum || chr(10) || parent), parent) AS round FROM outcomes),
        z AS (SELECT environment, stratum, parent, row_number() OVER (PARTITION BY environment ORDER BY round, stratum) AS taken FROM t)
        SELECT * FROM z WHERE taken <= 64
    """,
    "largest_remainder": f"""
        WITH {OUTCOMES}, c AS (SELECT environment, count(*) AS n FROM outcomes GROUP BY 1), b AS (SELECT *, least(n, 10) AS base FROM c),
        f AS (SELECT *, (300 - sum(base) OVER ())::BIGINT AS free, sum(n - base) OVER ()::BIGINT AS total FROM b), e AS (SELECT *, free * (n - base) // total AS part, free * (n - base) % total AS rest FROM f),
        l AS (SELECT *, free - sum(part) OVER () AS extra, row_number() OVER (ORDER BY rest DESC, environment) AS turn FROM e)
        SELECT environment, n, (base + part + CASE WHEN turn <= extra THEN 1 ELSE 0 END)::BIGINT AS seats FROM l
    """,
    "first_by_hash": f"WITH {OUTCOMES} SELECT stratum, outcome, parent, turn FROM (SELECT *, row_number() OVER (PARTITION BY stratum, outcome ORDER BY sha256('audit/1|' || parent), parent) AS turn FROM outcomes) WHERE turn <= 5",
    "fingerprint_groups": "WITH d AS (SELECT source, CASE WHEN length(text) > 40 THEN md5(text) END AS f FROM documents), g AS (SELECT source, CASE WHEN f IS NULL THEN source ELSE min(source) OVER (PARTITION BY f) END AS group_of FROM d) SELECT source, group_of, count(*) AS n FROM g GROUP BY ALL",
    "shift_grid": "SELECT a, p, CASE WHEN a = 0 AND p = 0 THEN 'identity' WHEN p = 0 THEN 'assignment_only' WHEN a = 0 THEN 'list_order_only' ELSE 'crossed' END AS kind, (a + p) % 6 AS offered, sha256('grid' || chr(10) || a || chr(10) || p) AS digest FROM range(6) x(a) CROSS JOIN range(6) y(p)",
    "padded_ids": "WITH i AS (SELECT item_id, 'obj_' || CASE WHEN length(item_id::VARCHAR) < 3 THEN lpad(item_id::VARCHAR, 3, '0') ELSE item_id::VARCHAR END AS object_id, 'cmd_' || substr(sha256(text), 1, 16) AS command_id FROM benchmark) SELECT *, row_number() OVER (ORDER BY object_id) AS ordinal FROM i",
}
