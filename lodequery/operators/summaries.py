"""Summaries of groups: votes, capped sums, contrasts with a reference cell, rates over a span, threshold fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import LOG, OUTCOMES, log, outcomes, read


def votes(df: DataFrame, keys: list[str], choice: str, least: int) -> DataFrame:
    """(keys, choice, n, cast): the choice of most rows, ties to the first by name; null below ``least`` votes. Null choices are no votes."""
    counted = df.filter(F.col(choice).isNotNull()).groupBy(*keys, choice).agg(F.count(F.lit(1)).alias("_n"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col(choice).alias("c"))).alias("_b"), F.sum("_n").alias("cast"))
    return best.select(*keys, F.when(-F.col("_b.m") >= least, F.col("_b.c")).alias("choice"), (-F.col("_b.m")).alias("n"), "cast")


def capped(df: DataFrame, keys: list[str], group: str, caps: range) -> DataFrame:
    """(keys, cap, total): for each cap the sum over the groups of at most that many rows of each."""
    sizes = df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n"))
    sums = sizes.groupBy(*keys).agg(*[F.sum(F.least(F.col("_n"), F.lit(c))).alias(f"_{c}") for c in caps])
    return sums.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"_{c}").alias("total")) for c in caps])))


def contrasts(df: DataFrame, keys: list[str], cell: str, reference: str, value: str) -> DataFrame:
    """(keys, cell, n, rate, change): each cell's mean and its difference from the reference cell of the same keys; null where that is missing."""
    means = df.groupBy(*keys, cell).agg(F.count(value).alias("n"), F.avg(value).alias("_r"))
    base = means.filter(F.col(cell) == reference).select(*keys, F.col("_r").alias("_base"))
    return means.join(base, keys, "left").select(*keys, cell, "n", F.round("_r", 9).alias("rate"), F.round(F.col("_r") - F.col("_base"), 9).alias("change"))


def span_rates(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, span_s, per_second): rows less one over the time from the first to the last; null for no span."""
    span = (F.max("utc_us") - F.min("utc_us")) / 1e6
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(span, 6).alias("span_s"), F.round(F.try_divide(F.count(F.lit(1)) - 1, span), 9).alias("per_second"))


def best_threshold(df: DataFrame, keys: list[str], x: str, y: str, thresholds: range) -> DataFrame:
    """(keys, threshold, error): the threshold that splits x so that the two means leave the least squared error of y; the smaller on ties.

    One pass: every candidate's sums of both sides, so no row is repeated for a candidate.
    """
    def sums(c: int) -> list:
        return [F.struct(*[f(F.when(side, F.col(y))).alias(name) for name, side, f in ((f"{k}{s}", test, agg) for s, test in (("l", F.col(x) < c), ("h", F.col(x) >= c)) for k, agg in (("n", F.count), ("v", F.var_pop)))]).alias(f"_{c}")]

    held = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(*[s for c in thresholds for s in sums(c)])
    part = lambda c, s: F.coalesce(F.col(f"_{c}.n{s}") * F.col(f"_{c}.v{s}"), F.lit(0.0))
    best = F.array_min(F.array(*[F.struct(F.round(part(c, "l") + part(c, "h"), 4).alias("error"), F.lit(c).alias("threshold")) for c in thresholds]))
    return held.select(*keys, best.alias("_b")).select(*keys, "_b.threshold", "_b.error")


def q_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes(log(spark, sf_dir), ["session"], "ev", 12)


def q_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capped(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_orderkey", range(1, 6))


def q_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrasts(outcomes(spark, sf_dir), ["environment"], "stratum", "1-URGENT", "first")


def q_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_rates(log(spark, sf_dir), ["session", "ev"])


def q_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_threshold(log(spark, sf_dir), ["ev"], "k", "value", range(10, 91, 10))


QUERIES = {"majority_votes": q_votes, "capped_sums": q_capped, "cell_contrasts": q_contrasts, "span_rates": q_rates, "best_threshold": q_threshold}
SQL = {
    "majority_votes": f"""
        WITH {LOG}, c AS (SELECT session, ev, count(*) AS n FROM log WHERE ev IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, ev) AS k, sum(n) OVER (PARTITION BY session) AS total FROM c)
        SELECT session, CASE WHEN n >= 12 THEN ev END AS choice, n, total::BIGINT AS cast FROM r WHERE k = 1
    """,
    "capped_sums": """
        WITH s AS (SELECT l_returnflag, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT unnest(range(1, 6))::INT AS cap)
        SELECT l_returnflag, cap, sum(least(n, cap))::BIGINT AS total FROM s CROSS JOIN c GROUP BY ALL
    """,
    "cell_contrasts": f"""
        WITH {OUTCOMES}, m AS (SELECT environment, stratum, count(first) AS n, avg(first) AS r FROM outcomes GROUP BY ALL)
        SELECT m.environment, m.stratum, m.n, round(m.r, 9) AS rate, round(m.r - b.r, 9) AS change FROM m LEFT JOIN m b ON b.environment = m.environment AND b.stratum = '1-URGENT'
    """,
    "span_rates": f"""
        WITH {LOG}, s AS (SELECT session, ev, count(*) AS n, (max(utc_us) - min(utc_us)) / 1000000.0::DOUBLE AS span FROM log GROUP BY ALL)
        SELECT session, ev, n, round(span, 6) AS span_s, CASE WHEN span > 0 THEN round((n - 1) / span, 9) END AS per_second FROM s
    """,
    "best_threshold": f"""
        WITH {LOG}, c AS (SELECT unnest(range(10, 91, 10))::INT AS threshold), s AS (SELECT ev, threshold, count(*) * var_pop(value) AS e FROM log CROSS JOIN c WHERE k IS NOT NULL AND value IS NOT NULL GROUP BY ev, threshold, k < threshold),
        t AS (SELECT ev, threshold, round(sum(e), 4) AS error FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY error, threshold) AS n FROM t)
        SELECT ev, threshold, error FROM r WHERE n = 1
    """,
}
