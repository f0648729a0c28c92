"""Validity codes, fates and exclusions: each rule a condition on the row, the codes of a row exploded into issue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import LOG, OBJECTS, log, objects, read

#: The fates of a detection in the order in which they are tried.
FATES = ("untracked", "tracking_reset", "unmapped_label", "below_min_score", "no_depth_hit", "too_far", "below_floor", "outside_room", "kept")
UNIT = 1e-6


def coded(rules: dict[str, Column]) -> Column:
    """The codes of all rules that hold for a row, in the order given; a rule that is unknown does not hold."""
    return F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules.items()]))


def issues(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, code) for every rule that a row breaks; rows without faults give none."""
    return df.select(*keys, F.explode(coded(rules)).alias("code"))


def first_of(rules: dict[str, Column], otherwise: str) -> Column:
    """The first code whose rule holds: later rules are not looked at."""
    out = None
    for code, rule in rules.items():
        out = F.when(rule, code) if out is None else out.when(rule, code)
    return out.otherwise(otherwise)


def object_rules() -> dict[str, Column]:
    """The rules of an object row with n, the rows that share its id in the scene."""
    norm = F.hypot("fx", "fy")
    return {
        "duplicate_object": F.col("n") > 1,
        "unknown_category": F.col("category").isNull(),
        "size_without_centre": F.col("cx").isNull() & F.col("sx").isNotNull(),
        "size_not_positive": F.least("sx", "sy", "sz") <= 0,
        "front_not_unit": F.abs(norm - 1) > UNIT,
        "size_out_of_range": F.greatest("sx", "sy", "sz") > 0.7,
    }


def contract_issues(things: DataFrame) -> DataFrame:
    counted = things.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("scene_id", "object_id")))
    return issues(counted, ["scene_id", "object_id"], object_rules())


def rotation_rules(x: str, y: str, z: str, w: str, support: str) -> dict[str, Column]:
    """Rules of a quaternion and the support it claims: full, yaw_only (no x, y) or axis_aligned (no turn)."""
    q = [F.col(c) for c in (x, y, z, w)]
    norm = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    return {
        "rotation_not_unit": F.abs(norm - 1) > UNIT,
        "rotation_not_yaw": (F.col(support) == "yaw_only") & (F.greatest(F.abs(q[0]), F.abs(q[1])) > UNIT),
        "rotation_not_aligned": (F.col(support) == "axis_aligned") & ((F.greatest(*[F.abs(c) for c in q[:3]]) > UNIT) | (F.abs(F.abs(q[3]) - 1) > UNIT)),
    }


def fated(detections: DataFrame, least: float, farthest: float, floor: float) -> DataFrame:
    """Adds fate: the first test that a detection fails, else kept."""
    return detections.withColumn(
        "fate",
        first_of(
            {
                "untracked": ~F.col("tracked"),
                "tracking_reset": F.col("epoch") != 0,
                "unmapped_label": F.col("category").isNull(),
                "below_min_score": F.col("score") < least,
                "no_depth_hit": F.col("range_m").isNull(),
                "too_far": F.col("range_m") > farthest,
                "below_floor": F.col("height_m") < floor,
                "outside_room": ~F.col("inside"),
            },
            "kept",
        ),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as detections of a scan (the supplier)."""
    key = F.col("l_orderkey")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("scan"),
        (key % 29 != 0).alias("tracked"),
        (key % 31 % 2 * (F.col("l_linenumber") % 5 == 0).cast("int")).alias("epoch"),
        F.when(F.col("l_suppkey") % 11 != 0, F.col("l_linestatus")).alias("category"),
        (F.col("l_discount") * 10).cast("double").alias("score"),
        F.when(key % 13 != 0, F.col("l_quantity").cast("double") / 5).alias("range_m"),
        (F.col("l_tax").cast("double") - 0.01).alias("height_m"),
        (F.col("l_partkey") % 9 != 0).alias("inside"),
    )


def q_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract_issues(objects(spark, sf_dir))


def q_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.element_at("embedding", i).cast("double")
    turn = F.when(F.col("vec_id") % 4 == 0, 0.0).otherwise(e(1))
    tilt = F.when(F.col("vec_id") % 3 == 0, e(2)).otherwise(0.0)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", tilt.alias("x"), F.lit(0.0).alias("y"), turn.alias("z"), F.sqrt(1 - turn * turn - F.when(F.col("vec_id") % 6 == 0, tilt * tilt).otherwise(0.0)).alias("w"), F.element_at(F.array(*map(F.lit, ("full", "yaw_only", "axis_aligned"))), (F.col("vec_id") % 5 % 3 + 1).cast("int")).alias("support"))
    return issues(rows, ["vec_id"], rotation_rules("x", "y", "z", "w", "support"))


def q_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of each scan by fate, with the fates that did not occur as zero."""
    counted = fated(detections(spark, sf_dir), 0.3, 8.0, 0.0).groupBy("scan").agg(*[F.count_if(F.col("fate") == f).alias(f) for f in FATES])
    return counted.select("scan", F.inline(F.array(*[F.struct(F.lit(f).alias("fate"), F.col(f).alias("n")) for f in FATES])))


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with every reason that keeps them out; a row without reasons is eligible."""
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_linestatus").alias("modes"))
    joined = read(spark, sf_dir, "orders").join(items, "o_orderkey", "left")
    rules = {"no_objects": F.col("n").isNull(), "too_few": F.col("n") < 3, "returned": F.col("returned") > 0, "open": F.col("o_orderstatus") != "F", "one_mode": F.col("modes") == 1}
    return joined.select("o_orderkey", coded(rules).alias("reasons"))


def q_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exclusions(spark, sf_dir).select("o_orderkey", (F.size("reasons") == 0).alias("eligible"), F.array_join("reasons", ",").alias("reasons"))


def q_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by reason; a row counts once for each of its reasons, and alone counts those with no other."""
    rows = exclusions(spark, sf_dir).select(F.explode("reasons").alias("reason"), (F.size("reasons") == 1).alias("alone"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("alone").alias("alone"))


def annotated(rows: DataFrame, keys: list[str], target: str, label: str) -> DataFrame:
    """Per command: whether its annotations name one target or several, and one label, several or none."""
    summed = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(target).alias("targets"), F.count_distinct(label).alias("labels"), F.min(target).alias("lowest"))
    spell = lambda c, one, many: F.when(F.col(c) > 1, many).when(F.col(c) == 1, one).otherwise("missing")
    return summed.select(*keys, "n", spell("targets", "unique", "conflicting").alias("target_status"), F.when(F.col("targets") == 1, F.col("lowest")).alias("target"), spell("labels", "consistent", "disagreeing").alias("label_status"))


def q_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey", "l_returnflag")


def partners(commands: DataFrame, scenes: DataFrame, key: str, revision: str) -> DataFrame:
    """Commands against scenes: a scene that is absent is a warning, one at another revision only an error."""
    known = scenes.select(F.col(key).alias("_k"), F.col(revision).alias("_r"), F.lit(True).alias("_is")).distinct()
    held = commands.join(known.groupBy("_k").agg(F.collect_set("_r").alias("_revisions")), F.col(key) == F.col("_k"), "left")
    code = F.when(F.col("_k").isNull(), "scene_missing").when(~F.array_contains("_revisions", F.col(revision)), "wrong_revision")
    severity = F.when(F.col("_k").isNull(), "warning").otherwise("error")
    return held.withColumn("code", code).filter(F.col("code").isNotNull()).withColumn("severity", severity).drop("_k", "_revisions")


def q_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.expr("if(p_partkey % 7 = 0, -1 - p_partkey, p_partkey)").alias("part"), (F.col("p_size") % 4).cast("bigint").alias("revision"))
    used = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), (F.col("l_linenumber") % 4).cast("bigint").alias("revision"))
    return partners(used, part, "part", "revision").select("l_orderkey", "l_linenumber", "code", "severity")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last report of each key: a later one replaces it whole."""
    fields = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("r")).select(*keys, "r.*")


def q_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(log(spark, sf_dir).select("session", "ev", "utc_us", "event_id", "value", "k"), ["session", "ev"], ["utc_us", "event_id"])


QUERIES = {
    "contract_issues": q_issues,
    "rotation_issues": q_rotations,
    "detection_fates": q_fates,
    "eligibility": q_eligibility,
    "exclusion_reasons": q_reasons,
    "annotation_status": q_annotations,
    "cross_records": q_partners,
    "latest_reports": q_latest,
}
_EXCLUDED = """
    items AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(DISTINCT l_linestatus) AS modes FROM lineitem GROUP BY 1),
    x AS (
        SELECT o_orderkey, list_filter([CASE WHEN n IS NULL THEN 'no_objects' END, CASE WHEN n < 3 THEN 'too_few' END, CASE WHEN returned > 0 THEN 'returned' END, CASE WHEN o_orderstatus <> 'F' THEN 'open' END, CASE WHEN modes = 1 THEN 'one_mode' END], lambda c: c IS NOT NULL) AS reasons
        FROM orders LEFT JOIN items ON l_orderkey = o_orderkey
    )
"""
SQL = {
    "contract_issues": f"""
        WITH {OBJECTS}, c AS (SELECT *, count(*) OVER (PARTITION BY scene_id, object_id) AS n FROM objects)
        SELECT scene_id, object_id, 'duplicate_object' AS code FROM c WHERE n > 1 UNION ALL SELECT scene_id, object_id, 'unknown_category' FROM c WHERE category IS NULL
        UNION ALL SELECT scene_id, object_id, 'size_without_centre' FROM c WHERE cx IS NULL AND sx IS NOT NULL UNION ALL SELECT scene_id, object_id, 'size_not_positive' FROM c WHERE least(sx, sy, sz) <= 0
        UNION ALL SELECT scene_id, object_id, 'front_not_unit' FROM c WHERE abs(sqrt(fx * fx + fy * fy) - 1) > {UNIT} UNION ALL SELECT scene_id, object_id, 'size_out_of_range' FROM c WHERE greatest(sx, sy, sz) > 0.7
    """,
    "rotation_issues": f"""
        WITH t AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN embedding[2]::DOUBLE ELSE 0 END AS x, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE embedding[1]::DOUBLE END AS z, ['full', 'yaw_only', 'axis_aligned'][(vec_id % 5 % 3 + 1)::INT] AS support FROM embeddings),
        q AS (SELECT *, sqrt(1 - z * z - CASE WHEN vec_id % 6 = 0 THEN x * x ELSE 0 END) AS w FROM t)
        SELECT vec_id, 'rotation_not_unit' AS code FROM q WHERE abs(sqrt(x * x + z * z + w * w) - 1) > {UNIT} UNION ALL SELECT vec_id, 'rotation_not_yaw' FROM q WHERE support = 'yaw_only' AND abs(x) > {UNIT}
        UNION ALL SELECT vec_id, 'rotation_not_aligned' FROM q WHERE support = 'axis_aligned' AND (greatest(abs(x), abs(z)) > {UNIT} OR abs(abs(w) - 1) > {UNIT})
    """,
    "detection_fates": f"""
        WITH d AS (
            SELECT l_suppkey AS scan, CASE WHEN l_orderkey % 29 = 0 THEN 'untracked' WHEN l_orderkey % 31 % 2 = 1 AND l_linenumber % 5 = 0 THEN 'tracking_reset' WHEN l_suppkey % 11 = 0 THEN 'unmapped_label'
                   WHEN (l_discount * 10)::DOUBLE < 0.3 THEN 'below_min_score' WHEN l_orderkey % 13 = 0 THEN 'no_depth_hit' WHEN l_quantity::DOUBLE / 5 > 8 THEN 'too_far' WHEN l_tax::DOUBLE - 0.01 < 0 THEN 'below_floor'
                   WHEN l_partkey % 9 = 0 THEN 'outside_room' ELSE 'kept' END AS fate
            FROM lineitem
        ), s AS (SELECT DISTINCT scan FROM d), f AS (SELECT unnest({list(FATES)}) AS fate)
        SELECT s.scan, f.fate, count(d.fate) AS n FROM s CROSS JOIN f LEFT JOIN d ON d.scan = s.scan AND d.fate = f.fate GROUP BY ALL
    """,
    "eligibility": f"WITH {_EXCLUDED} SELECT o_orderkey, len(reasons) = 0 AS eligible, array_to_string(reasons, ',') AS reasons FROM x",
    "exclusion_reasons": f"WITH {_EXCLUDED}, r AS (SELECT unnest(reasons) AS reason, len(reasons) = 1 AS alone FROM x) SELECT reason, count(*) AS n, count(*) FILTER (alone) AS alone FROM r GROUP BY 1",
    "annotation_status": """
        SELECT l_orderkey, count(*) AS n, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'conflicting' ELSE 'unique' END AS target_status, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS target,
               CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'disagreeing' ELSE 'consistent' END AS label_status FROM lineitem GROUP BY 1
    """,
    "cross_records": """
        WITH p AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN -1 - p_partkey ELSE p_partkey END AS part, p_size % 4 AS revision FROM part)
        SELECT l_orderkey, l_linenumber, CASE WHEN part IS NULL THEN 'scene_missing' ELSE 'wrong_revision' END AS code, CASE WHEN part IS NULL THEN 'warning' ELSE 'error' END AS severity
        FROM lineitem LEFT JOIN p ON part = l_partkey WHERE part IS NULL OR revision <> l_linenumber % 4
    """,
    "latest_reports": f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY session, ev ORDER BY utc_us DESC, event_id DESC) AS n FROM log) SELECT session, ev, utc_us, event_id, value, k FROM r WHERE n = 1",
}
