"""Provenance of values: every value names a source, and an evidence kind or a reason for being unknown that the source's kind permits.

Registries are joined by record and id, so records of any number of values spread over tasks; what is permitted is a small fixed table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import read

#: The kinds of source that may stand behind a known value of each evidence kind.
KNOWN = {"annotated": ("dataset", "fixture"), "inferred": ("dataset", "fixture", "prior_table"), "assumed": ("prior_table",), "measured": ()}
#: The kinds of source that may give each reason of an unknown value; None permits any.
UNKNOWN = {
    "not_in_source": ("dataset", "fixture"),
    "unmapped_label": ("dataset", "fixture"),
    "source_invalid": ("dataset", "fixture"),
    "withheld_by_profile": ("profile",),
    "no_permitted_prior": ("prior_table", "profile"),
    "not_estimated": None,
}


def registry(entries: DataFrame, keys: list[str], place: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(first entry of each id, ids that are there more than once)."""
    rows = entries.groupBy(*keys).agg(F.min(F.struct(place, value)).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return rows.select(*keys, F.col("_first")[value].alias(value)), rows.filter("_n > 1").select(*keys)


def provenance(values: DataFrame, sources: DataFrame, assumptions: DataFrame, known: dict = KNOWN, unknown: dict = UNKNOWN) -> DataFrame:
    """(record, path, code): unresolved sources and assumptions, evidence that its source cannot give, repeated registry entries.

    Values: record, path, state (known or unknown), evidence, reason, source, assumptions (an array; those of unknown values are not
    looked at). Sources: record, source, place, kind. Assumptions: record, assumption, place. Repeated entries count
    as their first. An evidence kind or reason outside the tables permits nothing.
    """
    kinds, twice = registry(sources, ["record", "source"], "place", "kind")
    held, again = registry(assumptions.withColumn("_one", F.lit(1)), ["record", "assumption"], "place", "_one")
    joined = values.join(kinds, ["record", "source"], "left")
    permits = F.lit(False)
    for table, state, column in ((known, "known", "evidence"), (unknown, "unknown", "reason")):
        for name, allowed in table.items():
            permits = F.when((F.col("state") == state) & (F.col(column) == name), F.lit(True) if allowed is None else F.col("kind").isin(*allowed) if allowed else F.lit(False)).otherwise(permits)
    code = F.when(F.col("kind").isNull(), "unresolved_source").when(~permits, "evidence_source")
    faults = joined.select("record", "path", code.alias("code")).filter("code is not null")
    used = values.filter("state = 'known'").select("record", "path", F.explode("assumptions").alias("assumption"))
    loose = used.join(held, ["record", "assumption"], "left_anti").select("record", "path", F.lit("unresolved_assumption").alias("code"))
    repeats = [df.select("record", F.col(c).alias("path"), F.lit("duplicate_registry").alias("code")) for df, c in ((twice, "source"), (again, "assumption"))]
    return faults.unionByName(loose).unionByName(repeats[0]).unionByName(repeats[1])


def q_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))
    items, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    values = items.select(
        F.col("l_orderkey").alias("record"),
        F.concat_ws("/", F.lit("v"), "l_linenumber").alias("path"),
        F.when(F.col("l_linestatus") == "O", "known").otherwise("unknown").alias("state"),
        pick(list(KNOWN), F.col("l_partkey")).alias("evidence"),
        pick(list(UNKNOWN), F.col("l_partkey")).alias("reason"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("source"),
        F.array(F.concat(F.lit("a"), F.col("l_partkey") % 3)).alias("assumptions"),
    )
    placed = orders.select(F.col("o_orderkey").alias("record"), F.explode(F.expr("if(o_orderkey % 10 = 0, array(0, 1, 2, 3), array(0, 1, 2))")).alias("place"))
    sources = placed.select("record", F.concat(F.lit("s"), F.col("place") % 3).alias("source"), "place", pick(["dataset", "fixture", "prior_table", "profile"], F.col("record") + F.col("place")).alias("kind"))
    assumptions = placed.filter("place < 1 + record % 2").select("record", F.concat(F.lit("a"), F.col("place")).alias("assumption"), "place")
    return provenance(values, sources, assumptions)


QUERIES = {"provenance_issues": q_provenance}
SQL = {
    "provenance_issues": """
        WITH v AS (
            SELECT l_orderkey AS record, 'v/' || l_linenumber AS path, l_linestatus = 'O' AS known, ['annotated', 'inferred', 'assumed', 'measured'][(l_partkey % 4 + 1)::INT] AS evidence,
                   ['not_in_source', 'unmapped_label', 'source_invalid', 'withheld_by_profile', 'no_permitted_prior', 'not_estimated'][(l_partkey % 6 + 1)::INT] AS reason, (l_suppkey % 4)::INT AS s, (l_partkey % 3)::INT AS a
            FROM lineitem
        ), k AS (
            SELECT *, CASE WHEN s < 3 THEN ['dataset', 'fixture', 'prior_table', 'profile'][((record + s) % 4 + 1)::INT] END AS kind FROM v
        ), j AS (
            SELECT record, path, CASE WHEN kind IS NULL THEN 'unresolved_source'
                   WHEN known AND NOT CASE evidence WHEN 'annotated' THEN kind IN ('dataset', 'fixture') WHEN 'inferred' THEN kind <> 'profile' WHEN 'assumed' THEN kind = 'prior_table' ELSE FALSE END THEN 'evidence_source'
                   WHEN NOT known AND NOT CASE reason WHEN 'withheld_by_profile' THEN kind = 'profile' WHEN 'no_permitted_prior' THEN kind IN ('prior_table', 'profile') WHEN 'not_estimated' THEN TRUE ELSE kind IN ('dataset', 'fixture') END THEN 'evidence_source' END AS code
            FROM k
        )
        SELECT * FROM j WHERE code IS NOT NULL
        UNION ALL SELECT record, path, 'unresolved_assumption' FROM v WHERE known AND a >= 1 + record % 2
        UNION ALL SELECT o_orderkey, 's0', 'duplicate_registry' FROM orders WHERE o_orderkey % 10 = 0
    """,
}
