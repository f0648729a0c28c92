"""Scoring: counts and ratios with their parts, crosstabs, paired tables, weighted estimators, cluster bootstrap."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import OUTCOMES, outcomes

OUTCOME_NAMES = ("F", "O", "P", "X")  # X never occurs: bins are filled with zero

#: Draws of at most so many rows (12 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of draws that a task hands on at a time.
PART_ROWS = 50_000


def ratio(hits: Column, total: Column) -> Column:
    return F.round(F.try_divide(hits.cast("double"), total), 9)


def zero_filled(df: DataFrame, keys: list[str], bin_: str, names: tuple[str, ...]) -> DataFrame:
    """A count for each group and each named bin, zero where there is none; one pass, no join."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(bin_) == n).alias(n) for n in names]).unpivot(keys, list(names), bin_, "n")


def crosstab(df: DataFrame, row: str, column: str, names: tuple[str, ...]) -> DataFrame:
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == n).alias(f"n_{n}") for n in names], F.count(F.lit(1)).alias("n"))


def paired(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """The 2 x 2 table of two systems on the same items, and the items one of them lacks."""
    a, b = F.col(first) == 1, F.col(second) == 1
    return df.groupBy(*keys).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.count_if(~a & ~b).alias("neither"), F.count_if(F.col(first).isNull() | F.col(second).isNull()).alias("not_comparable"))


def weighted(sampled: DataFrame, frame: DataFrame, value: str) -> DataFrame:
    """Estimates from a stratified sample: (environment, stratum, value) and the frame's (environment, stratum, population).

    command: sum of (N/n) y over sum of N. environment: mean over environments of sum of (N_es / N_e) mean(y).
    unweighted: plain mean.
    """
    cells = sampled.groupBy("environment", "stratum").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("hits")).join(frame, ["environment", "stratum"])
    by_env = cells.groupBy("environment").agg(F.sum(F.col("population") * F.col("hits") / F.col("n")).alias("up"), F.sum("population").alias("down"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    return by_env.agg(F.round(F.sum("up") / F.sum("down"), 9).alias("command"), F.round(F.avg(F.col("up") / F.col("down")), 9).alias("environment"), F.round(F.sum("hits") / F.sum("n"), 9).alias("unweighted"))


def draws(spark: SparkSession, clusters: list, replicates: int, seed: int) -> DataFrame:
    """(replicate, cluster, times) of paired cluster draws; the table is replicates x clusters at most.

    One generator runs through all replicates, so a task makes them in order, outside the driver, and holds one at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            source, parts, size = random.Random(seed), [], 0
            for replicate in range(replicates):
                times = Counter(source.choice(clusters) for _ in clusters)
                parts.append(pd.DataFrame({"replicate": replicate, "cluster": list(times), "times": list(times.values())}))
                size += len(times)
                if size >= PART_ROWS or replicate == replicates - 1:
                    yield pd.concat(parts)
                    parts, size = [], 0

    return spark.range(1, numPartitions=1).mapInPandas(run, "replicate int, cluster int, times int")


def bootstrap(df: DataFrame, cluster: str, value: str, replicates: int = 10_000, seed: int = 20261010, level_per_mille: int = 950) -> DataFrame:
    """Percentile interval of the mean under cluster resampling; rows are summed by cluster before they meet the draws."""
    sums = df.groupBy(F.col(cluster).cast("int").alias("cluster")).agg(F.sum(value).alias("up"), F.count(F.lit(1)).alias("down"))
    clusters = sorted(r["cluster"] for r in sums.select("cluster").collect())
    table = draws(df.sparkSession, clusters, replicates, seed)
    small = len(clusters) * replicates <= BROADCAST_ROWS
    means = sums.join(F.broadcast(table) if small else table, "cluster").groupBy("replicate").agg((F.sum(F.col("up") * F.col("times")) / F.sum(F.col("down") * F.col("times"))).alias("mean"))
    tail = (1000 - level_per_mille) // 2
    place = lambda per_mille: -(-per_mille * replicates // 1000)
    ordered = means.withColumn("k", F.row_number().over(Window.orderBy("mean")))  # one row for each replicate
    at = lambda k, name: F.round(F.max(F.when(F.col("k") == k, F.col("mean"))), 9).alias(name)
    return ordered.agg(at(max(1, place(tail)), "low"), at(place(1000 - tail), "high"), F.count(F.lit(1)).alias("replicates"))


def macro_and_pooled(df: DataFrame, group: str, value: str) -> DataFrame:
    by = df.groupBy(group).agg(F.sum(value).alias("up"), F.count(value).alias("down"))
    return by.agg(F.round(F.avg(F.try_divide(F.col("up"), F.col("down"))), 9).alias("macro"), F.round(F.sum("up") / F.sum("down"), 9).alias("pooled"))


def cumulative_by_limit(df: DataFrame, key: str, limits: range) -> DataFrame:
    """How many groups have at most so many rows, and the capped sum of rows, for each limit: one pass over a histogram."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
    wide = sizes.withColumn("limit", F.explode(F.array(*map(F.lit, limits))))
    return wide.groupBy("limit").agg(F.sum(F.when(F.col("size") <= F.col("limit"), F.col("groups")).otherwise(0)).cast("bigint").alias("within"), F.sum(F.least("size", "limit") * F.col("groups")).cast("bigint").alias("capped"))


def consensus(df: DataFrame, key: str) -> DataFrame:
    """One result of several interpretations (status, target): unsupported before insufficient before agreement before no match before ambiguous."""
    some = lambda s: F.bool_or(F.col("status") == s)
    each = lambda s: F.bool_and(F.col("status") == s)
    status = F.when(some("unsupported"), "unsupported").when(some("insufficient_information"), "insufficient_information").when(each("resolved") & (F.count_distinct("target") == 1), "resolved").when(each("no_match"), "no_match").otherwise("ambiguous")
    return df.groupBy(key).agg(status.alias("result"), F.count(F.lit(1)).alias("interpretations"), F.when(each("resolved") & (F.count_distinct("target") == 1), F.min("target")).alias("agreed"))


def q_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).groupBy("environment", "stratum").agg(F.sum("first").cast("bigint").alias("numerator"), F.count(F.lit(1)).alias("denominator"), ratio(F.sum("first"), F.count(F.lit(1))).alias("value"))


def q_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zero_filled(outcomes(spark, sf_dir), ["environment"], "outcome", OUTCOME_NAMES)


def q_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstab(outcomes(spark, sf_dir), "stratum", "outcome", OUTCOME_NAMES)


def q_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(outcomes(spark, sf_dir), ["environment"], "first", "second")


def q_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = outcomes(spark, sf_dir)
    frame = every.groupBy("environment", "stratum").agg(F.count(F.lit(1)).alias("population"))
    return weighted(every.filter(F.col("parent") % 5 == 0), frame, "first")


def q_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap(outcomes(spark, sf_dir), "environment", "first")


def q_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro_and_pooled(outcomes(spark, sf_dir), "environment", "first")


def q_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cumulative_by_limit(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", range(3, 11))


def q_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    status = F.when(F.col("l_returnflag") == "R", "no_match").when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 6), "unsupported").when(F.col("l_quantity") > 48, "insufficient_information").otherwise("resolved")
    return consensus(items.select("l_orderkey", status.alias("status"), (F.col("l_suppkey") % 3).alias("target")), "l_orderkey")


QUERIES = {"ratio_parts": q_ratios, "zero_filled_bins": q_bins, "crosstab": q_crosstab, "paired_table": q_paired, "weighted_estimates": q_weighted, "cluster_bootstrap": q_bootstrap, "macro_pooled": q_macro, "cumulative_limits": q_limits, "consensus": q_consensus}
SQL = {
    "ratio_parts": f"WITH {OUTCOMES} SELECT environment, stratum, sum(first)::BIGINT AS numerator, count(*) AS denominator, round(sum(first)::DOUBLE / count(*), 9) AS value FROM outcomes GROUP BY ALL",
    "zero_filled_bins": f"WITH {OUTCOMES}, b AS (SELECT unnest(['F', 'O', 'P', 'X']) AS outcome) SELECT e.environment, b.outcome, count(o.parent) AS n FROM (SELECT DISTINCT environment FROM outcomes) e CROSS JOIN b LEFT JOIN outcomes o ON o.environment = e.environment AND o.outcome = b.outcome GROUP BY ALL",
    "crosstab": f"WITH {OUTCOMES} SELECT stratum, count(*) FILTER (outcome = 'F') AS n_F, count(*) FILTER (outcome = 'O') AS n_O, count(*) FILTER (outcome = 'P') AS n_P, count(*) FILTER (outcome = 'X') AS n_X, count(*) AS n FROM outcomes GROUP BY stratum",
    "paired_table": f"WITH {OUTCOMES} SELECT environment, count(*) FILTER (first = 1 AND second = 1) AS both, count(*) FILTER (first = 1 AND second = 0) AS only_first, count(*) FILTER (first = 0 AND second = 1) AS only_second, count(*) FILTER (first = 0 AND second = 0) AS neither, count(*) FILTER (first IS NULL OR second IS NULL) AS not_comparable FROM outcomes GROUP BY ALL",
    "weighted_estimates": f"""
        WITH {OUTCOMES}, p AS (SELECT environment, stratum, count(*) AS big FROM outcomes GROUP BY ALL), s AS (SELECT environment, stratum, count(*) AS n, sum(first) AS hits FROM outcomes WHERE parent % 5 = 0 GROUP BY ALL),
        e AS (SELECT environment, sum(big * hits::DOUBLE / n) AS up, sum(big) AS down, sum(hits) AS hits, sum(n) AS n FROM s JOIN p USING (environment, stratum) GROUP BY 1)
        SELECT round(sum(up) / sum(down), 9) AS command, round(avg(up / down), 9) AS environment, round(sum(hits) / sum(n)::DOUBLE, 9) AS unweighted FROM e
    """,
    "macro_pooled": f"WITH {OUTCOMES}, g AS (SELECT environment, sum(first)::DOUBLE AS up, count(first) AS down FROM outcomes GROUP BY 1) SELECT round(avg(up / down), 9) AS macro, round(sum(up) / sum(down), 9) AS pooled FROM g",
    "cumulative_limits": "WITH s AS (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) SELECT l::INT AS \"limit\", count(*) FILTER (size <= l) AS within, sum(least(size, l))::BIGINT AS capped FROM s CROSS JOIN range(3, 11) r(l) GROUP BY l",
    "consensus": """
        WITH i AS (SELECT l_orderkey, l_suppkey % 3 AS target, CASE WHEN l_returnflag = 'R' THEN 'no_match' WHEN l_linestatus = 'O' AND l_linenumber = 6 THEN 'unsupported' WHEN l_quantity > 48 THEN 'insufficient_information' ELSE 'resolved' END AS status FROM lineitem),
        g AS (SELECT l_orderkey, bool_and(status = 'resolved') AND count(DISTINCT target) = 1 AS agree, bool_or(status = 'unsupported') AS u, bool_or(status = 'insufficient_information') AS s, bool_and(status = 'no_match') AS nm, count(*) AS interpretations, min(target) AS t FROM i GROUP BY 1)
        SELECT l_orderkey, CASE WHEN u THEN 'unsupported' WHEN s THEN 'insufficient_information' WHEN agree THEN 'resolved' WHEN nm THEN 'no_match' ELSE 'ambiguous' END AS result, interpretations, CASE WHEN agree THEN t END AS agreed FROM g
    """,
}
