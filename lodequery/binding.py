"""Views of the driver's tables in the engine's terms, in Spark and, for the SQL oracles, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AXES = "xyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene objects: box, category, semantic front. The centre, and so the box, is unknown for one in 17."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    known = F.col("vec_id") % 17 != 0
    kind = F.element_at(F.array(*[F.lit(x) for x in ("table", "chair", "box", "lamp")], F.lit(None)), (F.col("vec_id") % 5 + 1).cast("int"))
    base = read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("scene_id"),
        F.col("vec_id").alias("object_id"),
        kind.alias("category"),
        F.element_at(F.array(*map(F.lit, ("red", "green", "blue"))), (F.col("vec_id") % 3 + 1).cast("int")).alias("colour"),
        *[F.when(known, 10 * e(i + 1)).alias(f"c{s}") for i, s in enumerate(AXES)],
        *[(0.2 + 2 * F.abs(e(i + 4))).alias(f"s{s}") for i, s in enumerate(AXES)],
        e(7).alias("fx"),
        e(8).alias("fy"),
    )
    low = [(F.col(f"c{s}") - F.col(f"s{s}") / 2).alias(f"{s}_min") for s in AXES]
    high = [(F.col(f"c{s}") + F.col(f"s{s}") / 2).alias(f"{s}_max") for s in AXES]
    return base.select("*", *low, *high)


OBJECTS = """
    o0 AS (
        SELECT label::BIGINT AS scene_id, vec_id AS object_id,
               CASE vec_id % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'chair' WHEN 2 THEN 'box' WHEN 3 THEN 'lamp' END AS category,
               ['red', 'green', 'blue'][(vec_id % 3 + 1)::INT] AS colour,
               CASE WHEN vec_id % 17 <> 0 THEN 10 * embedding[1]::DOUBLE END AS cx, CASE WHEN vec_id % 17 <> 0 THEN 10 * embedding[2]::DOUBLE END AS cy,
               CASE WHEN vec_id % 17 <> 0 THEN 10 * embedding[3]::DOUBLE END AS cz,
               0.2::DOUBLE + 2 * abs(embedding[4]::DOUBLE) AS sx, 0.2::DOUBLE + 2 * abs(embedding[5]::DOUBLE) AS sy, 0.2::DOUBLE + 2 * abs(embedding[6]::DOUBLE) AS sz,
               embedding[7]::DOUBLE AS fx, embedding[8]::DOUBLE AS fy
        FROM embeddings
    ), objects AS (
        SELECT *, cx - sx / 2 AS x_min, cy - sy / 2 AS y_min, cz - sz / 2 AS z_min, cx + sx / 2 AS x_max, cy + sy / 2 AS y_max, cz + sz / 2 AS z_max FROM o0
    )
"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: a session for each user, seq from 0, microseconds, the number in the data."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"),
        (F.row_number().over(order) - 1).cast("bigint").alias("seq"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("utc_us"),
        F.col("event_type").alias("ev"),
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


LOG = """
    log AS (
        SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id, epoch_us(ts) AS utc_us,
               event_type AS ev, value, (props->>'$.k')::BIGINT AS k
        FROM events
    )
"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored requests of two systems: environment, stratum, parent, and whether each is right."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("first"), F.max((F.col("l_linestatus") == "O").cast("int")).alias("second"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(items, "o_orderkey")
        .select(F.col("o_orderkey").alias("parent"), F.col("c_nationkey").alias("environment"), F.col("o_orderpriority").alias("stratum"), "first", "second", F.col("o_orderstatus").alias("outcome"))
    )


OUTCOMES = """
    outcomes AS (
        SELECT o_orderkey AS parent, c_nationkey AS environment, o_orderpriority AS stratum, first, second, o_orderstatus AS outcome
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN (SELECT l_orderkey, max((l_returnflag = 'R')::INT) AS first, max((l_linestatus = 'O')::INT) AS second FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    )
"""
