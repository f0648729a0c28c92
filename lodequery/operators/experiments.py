"""Experiments: paired differences within replicates, spread over seeds, accuracy within another outcome, grids, totals and samples.

Every operator is one or two aggregates with a map-side combine. Lists are collected only where their length is bounded by
the design (replicates, seeds, the last K points), never by the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import LOG, OUTCOMES, log, outcomes, read

# The interval's level in thousandths, the points of a running median, the seconds of a bucket.
TAIL, LAST, BUCKET_S = 25, 64, 3600
EARLIER, TRAIN, HELD_OUT = "parent % 4 = 0", "parent % 5 < 3", "parent % 5 = 4"


def nearest_rank(values: Column, thousandths: int) -> Column:
    """The value at rank ceil(q n) of a sorted array, by integers."""
    return F.when(F.size(values) > 0, F.element_at(values, F.greatest(F.lit(1), F.ceil(F.size(values) * F.lit(thousandths) / 1000)).cast("int")))


def replicate_differences(df: DataFrame, keys: list[str], replicate: str, first: str, second: str) -> DataFrame:
    """(keys, estimate, low, high, replicates): mean(first) - mean(second), and the interval of the same difference within each replicate.

    A replicate without either mean is left out of the interval.
    """
    gap = (F.avg(first) - F.avg(second)).alias("gap")
    within = df.groupBy(*keys, replicate).agg(gap).filter("gap is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.round("gap", 9))).alias("gaps"))
    whole = df.groupBy(*keys).agg(F.round(F.avg(first) - F.avg(second), 9).alias("estimate"))
    return whole.join(within, keys, "left").select(*keys, "estimate", nearest_rank(F.col("gaps"), TAIL).alias("low"), nearest_rank(F.col("gaps"), 1000 - TAIL).alias("high"), F.coalesce(F.size("gaps"), F.lit(0)).alias("replicates"))


def seed_summaries(df: DataFrame, keys: list[str], seed: str, value: str) -> DataFrame:
    """(keys, seeds, mean, least, most, deviation) of the seeds' means; one seed has no deviation."""
    means = df.groupBy(*keys, seed).agg(F.avg(value).alias("m"))
    return means.groupBy(*keys).agg(F.count("m").alias("seeds"), F.round(F.avg("m"), 9).alias("mean"), F.round(F.min("m"), 9).alias("least"), F.round(F.max("m"), 9).alias("most"), F.round(F.stddev_samp("m"), 9).alias("deviation"))


def accuracy_within(sampled: DataFrame, frame: DataFrame, within: str, value: str) -> DataFrame:
    """(within, rows, accuracy): accuracy of one system within each outcome of another, each row weighing N / n of its cell.

    ``frame`` has (environment, stratum, population).
    """
    cells = sampled.groupBy("environment", "stratum", within).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("hits"))
    sizes = cells.groupBy("environment", "stratum").agg(F.sum("rows").alias("n")).join(frame, ["environment", "stratum"])
    weighed = cells.join(sizes, ["environment", "stratum"]).withColumn("w", F.col("population") / F.col("n"))
    return weighed.groupBy(within).agg(F.sum("rows").alias("rows"), F.round(F.sum(F.col("w") * F.col("hits")) / F.sum(F.col("w") * F.col("rows")), 9).alias("accuracy"))


def grid_metrics(df: DataFrame, base: str, row: str, column: str, choice: str, hit: str, n: int) -> DataFrame:
    """(base, cells, complete, identity, modal, modal_count, modal_share, hits) of a base's n x n grid; ties of the modal choice go to the one seen first."""
    place = F.col(row) * n + F.col(column)
    met = df.groupBy(base, choice).agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("seen"))
    modal = met.groupBy(base).agg(F.max_by(choice, F.struct("times", -F.col("seen"))).alias("modal"), F.max("times").alias("modal_count"))
    whole = df.groupBy(base).agg(F.count_distinct(place).alias("cells"), F.count(F.lit(1)).alias("n_rows"), F.max(F.when(place == 0, F.col(choice))).alias("identity"), F.sum(hit).alias("hits"))
    return whole.join(modal, base).select(
        base, "cells", ((F.col("cells") == n * n) & (F.col("n_rows") == n * n)).alias("complete"), "identity", "modal", "modal_count", F.round(F.col("modal_count") / F.col("n_rows"), 9).alias("modal_share"), "hits"
    )


def map_totals(df: DataFrame, key: str, values: Column) -> DataFrame:
    """(key, name, total, average): sums of a map's values by name; averages over all samples of the key, also those without the name."""
    samples = df.groupBy(key).agg(F.count(F.lit(1)).alias("samples"))
    total = df.select(key, F.explode(values).alias("name", "v")).filter("v is not null").groupBy(key, "name").agg(F.sum("v").alias("total"))
    return total.join(samples, key).select(key, "name", F.round("total", 6).alias("total"), F.round(F.col("total") / F.col("samples"), 9).alias("average"))


def column_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, total, most) of each column in one pass."""
    both = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("total", F.sum), ("most", F.max))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.col(f"{c}_total").cast("double"), 2).alias("total"), F.col(f"{c}_most").cast("double").alias("most")) for c in columns]))
    return both.select(rows.alias("r")).select("r.*")


def running_median(df: DataFrame, keys: list[str], order: list[str], value: str, last: int = LAST) -> DataFrame:
    """Adds median: of the last ``last`` known values up to the row; null before the first."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(last - 1), 0)
    return df.withColumn("_v", F.sort_array(F.collect_list(value).over(frame))).withColumn("median", middle(F.col("_v"))).drop("_v")


def middle(ordered: Column) -> Column:
    """The median of a sorted array; the mean of the two middle values of an even number."""
    n = F.size(ordered)
    at = lambda i: F.element_at(ordered, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def inventory(df: DataFrame, group: str, part: str, item: str, kind: str) -> DataFrame:
    """(group, items, parts, kinds, least, median, most): distinct counts, and the spread of the parts' sizes."""
    sizes = df.groupBy(group, part).agg(F.count(F.lit(1)).alias("n"))
    spread = sizes.groupBy(group).agg(F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"))
    return df.groupBy(group).agg(F.count_distinct(item).alias("items"), F.count_distinct(part).alias("parts"), F.count_distinct(kind).alias("kinds")).join(spread, group)


def salted_order(salt: str, *columns: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in columns]), 256)


def salted_rounds(df: DataFrame, group: str, stratum: str, item: str, cap: int, salt: str, stratum_salt: str) -> DataFrame:
    """(group, stratum, item, rank): up to ``cap`` items of a group, one of each stratum in turn; strata and items in salted orders.

    An item below its stratum's rank ``cap`` cannot be taken, so it is dropped before the group is ordered.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group, stratum).orderBy(salted_order(salt, group, stratum, item), item)) - 1).filter(F.col("rank") < cap)
    turn = F.row_number().over(Window.partitionBy(group).orderBy("rank", salted_order(stratum_salt, group, stratum), stratum))
    return ranked.withColumn("_turn", turn).filter(F.col("_turn") <= cap).select(group, stratum, item, "rank")


def stale_spread(marks: DataFrame, stale: DataFrame, keys: list[str], bucket: str, step: str) -> DataFrame:
    """(keys, step, share): stale counts of a bucket spread evenly over the marks in it; what no mark takes is under step ``none``."""
    met = marks.groupBy(*keys, bucket, step).agg(F.count(F.lit(1)).alias("n"))
    lost = stale.groupBy(*keys, bucket).agg(F.sum("stale").alias("stale")).filter("stale > 0")
    per = met.groupBy(*keys, bucket).agg(F.sum("n").alias("marks"))
    shares = lost.join(per, [*keys, bucket], "left").join(met, [*keys, bucket], "left")
    placed = F.when(F.col("marks").isNull(), F.col("stale")).otherwise(F.col("stale") * F.col("n") / F.col("marks"))
    return shares.withColumn("_s", placed).groupBy(*keys, F.coalesce(step, F.lit("none")).alias(step)).agg(F.round(F.sum("_s"), 6).alias("share"))


def heaviest(df: DataFrame, key: str, name: str, value: str, most: int, least_share: float) -> DataFrame:
    """(key, place, name, share): the heaviest names of each key with at least a share, ``most`` of them."""
    sums = df.filter(F.col(value).isNotNull()).groupBy(key, name).agg(F.round(F.sum(value), 6).alias("s"))
    shared = sums.withColumn("share", F.round(F.try_divide("s", F.sum("s").over(Window.partitionBy(key))), 9))
    placed = shared.filter(F.col("share") >= least_share).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("share"), name)))
    return placed.filter(F.col("place") <= most).select(key, "place", name, "share")


def remaining_pool(pool: DataFrame, earlier: DataFrame, key: str, by: str) -> DataFrame:
    """(by, pool, earlier, left_over): sizes of a pool before and after an earlier sample is taken out."""
    left = pool.join(earlier.select(key), key, "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("left_over"))
    return pool.groupBy(by).agg(F.count(F.lit(1)).alias("pool")).join(left, by, "left").fillna(0, ["left_over"]).select(by, "pool", (F.col("pool") - F.col("left_over")).alias("earlier"), "left_over")


def split_membership(df: DataFrame, lists: dict[str, DataFrame], key: str, by: str) -> DataFrame:
    """(by, a count for each list, several, unlisted): membership of keys in named lists, by one union instead of a join for each."""
    named = [rows.select(key, F.lit(n).alias("_list")) for n, rows in lists.items()]
    tags = named[0]
    for other in named[1:]:
        tags = tags.unionByName(other)
    met = tags.groupBy(key).agg(F.collect_set("_list").alias("_lists"))
    rows = df.join(met, key, "left").withColumn("_lists", F.coalesce("_lists", F.array().cast("array<string>")))
    return rows.groupBy(by).agg(*[F.count_if(F.array_contains("_lists", n)).alias(n) for n in lists], F.count_if(F.size("_lists") > 1).alias("several"), F.count_if(F.size("_lists") == 0).alias("unlisted"))


def planning_estimate(df: DataFrame, by: str, size: str, fixed: float, each: float) -> DataFrame:
    """(by, requests, seconds): the sum of a + b * size."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), F.round(F.lit(fixed) * F.count(F.lit(1)) + F.lit(each) * F.sum(size), 6).alias("seconds"))


def grid(df: DataFrame) -> DataFrame:
    """Outcomes dealt on a 3 x 3 grid for each environment: the first parent of each cell."""
    cell = df.withColumn("row", F.col("parent") % 3).withColumn("column", F.floor(F.col("parent") / 3) % 3)
    first = cell.groupBy("environment", "row", "column").agg(F.min(F.struct("parent", "stratum", "first")).alias("f"))
    return first.select("environment", "row", "column", "f.stratum", "f.first")


def q_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = outcomes(spark, sf_dir)
    frame = whole.groupBy("environment", "stratum").agg(F.count(F.lit(1)).alias("population"))
    return accuracy_within(whole.filter(EARLIER), frame, "outcome", "first")


def q_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).withColumn("bucket", F.floor(F.col("utc_us") / (BUCKET_S * 1_000_000)))
    return stale_spread(rows.filter("seq % 7 <> 0"), rows.filter("seq % 7 = 0").select("session", "bucket", F.coalesce(F.col("k"), F.lit(0)).alias("stale")), ["session"], "bucket", "ev")


def q_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes(spark, sf_dir)
    return split_membership(rows, {"train": rows.filter(TRAIN), "held_out": rows.filter(HELD_OUT), "earlier": rows.filter(EARLIER)}, "parent", "environment")


QUERIES = {
    "replicate_differences": lambda s, d: replicate_differences(outcomes(s, d).withColumn("replicate", F.col("parent") % 20), ["environment"], "replicate", "first", "second"),
    "seed_summaries": lambda s, d: seed_summaries(outcomes(s, d).withColumn("seed", F.col("parent") % 3), ["environment", "stratum"], "seed", "first"),
    "accuracy_within": q_within,
    "grid_metrics": lambda s, d: grid_metrics(grid(outcomes(s, d)), "environment", "row", "column", "stratum", "first", 3),
    "map_totals": lambda s, d: map_totals(log(s, d), "session", F.create_map(F.lit("value"), F.col("value").cast("double"), F.lit("k"), F.col("k").cast("double"))),
    "column_totals": lambda s, d: column_totals(read(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "running_median": lambda s, d: running_median(log(s, d), ["session"], ["seq"], "value").select("session", "seq", F.round("median", 9).alias("median")),
    "inventory_spread": lambda s, d: inventory(outcomes(s, d), "environment", "stratum", "parent", "outcome"),
    "salted_rounds": lambda s, d: salted_rounds(outcomes(s, d), "environment", "stratum", "parent", 64, "pick-1", "strata-1"),
    "stale_spread": q_stale,
    "heaviest_names": lambda s, d: heaviest(log(s, d), "session", "ev", "value", 5, 0.05),
    "remaining_pool": lambda s, d: remaining_pool(outcomes(s, d), outcomes(s, d).filter(EARLIER), "parent", "environment"),
    "split_membership": q_lists,
    "planning_estimate": lambda s, d: planning_estimate(read(s, d, "documents").withColumn("n", F.length(F.coalesce("text", F.lit("")))), "lang", "n", 0.25, 0.001),
}

_ranks = "list_sort(list(gap))"
SQL = {
    "replicate_differences": f"""
        WITH {OUTCOMES}, reps AS (
            SELECT environment, round(avg(first) - avg(second), 9) AS gap FROM outcomes GROUP BY environment, parent % 20
        ), lists AS (SELECT environment, {_ranks} AS gaps FROM reps WHERE gap IS NOT NULL GROUP BY environment)
        SELECT o.environment, o.estimate, gaps[greatest(1, (len(gaps) * 25 + 999) // 1000)] AS low, gaps[greatest(1, (len(gaps) * 975 + 999) // 1000)] AS high, coalesce(len(gaps), 0) AS replicates
        FROM (SELECT environment, round(avg(first) - avg(second), 9) AS estimate FROM outcomes GROUP BY environment) o LEFT JOIN lists USING (environment)
    """,
    "seed_summaries": f"""
        WITH {OUTCOMES}, means AS (SELECT environment, stratum, parent % 3 AS seed, avg(first) AS m FROM outcomes GROUP BY ALL)
        SELECT environment, stratum, count(m) AS seeds, round(avg(m), 9) AS mean, round(min(m), 9) AS least, round(max(m), 9) AS most, round(stddev_samp(m), 9) AS deviation FROM means GROUP BY ALL
    """,
    "accuracy_within": f"""
        WITH {OUTCOMES}, frame AS (SELECT environment, stratum, count(*) AS population FROM outcomes GROUP BY ALL),
        sampled AS (SELECT *, count(*) OVER (PARTITION BY environment, stratum) AS n FROM outcomes WHERE {EARLIER})
        SELECT outcome, count(*) AS rows, round(sum(population / n * first) / sum(population / n), 9) AS accuracy FROM sampled JOIN frame USING (environment, stratum) GROUP BY outcome
    """,
    "grid_metrics": f"""
        WITH {OUTCOMES}, cells AS (
            SELECT environment, parent % 3 AS r, (parent // 3) % 3 AS c, arg_min(stratum, parent) AS stratum, arg_min(first, parent) AS first FROM outcomes GROUP BY ALL
        ), met AS (SELECT environment, stratum, count(*) AS times, min(r * 3 + c) AS seen FROM cells GROUP BY ALL),
        modal AS (SELECT environment, stratum AS modal, times AS modal_count FROM met QUALIFY row_number() OVER (PARTITION BY environment ORDER BY times DESC, seen) = 1)
        SELECT environment, count(DISTINCT r * 3 + c) AS cells, count(DISTINCT r * 3 + c) = 9 AND count(*) = 9 AS complete, max(CASE WHEN r * 3 + c = 0 THEN cells.stratum END) AS identity,
               any_value(modal) AS modal, any_value(modal_count) AS modal_count, round(any_value(modal_count) / count(*), 9) AS modal_share, sum(first)::BIGINT AS hits
        FROM cells JOIN modal USING (environment) GROUP BY environment
    """,
    "map_totals": f"""
        WITH {LOG}, samples AS (SELECT session, count(*) AS samples FROM log GROUP BY 1),
        long AS (SELECT session, 'value' AS name, value::DOUBLE AS v FROM log UNION ALL SELECT session, 'k', k::DOUBLE FROM log)
        SELECT session, name, round(sum(v), 6) AS total, round(sum(v) / any_value(samples), 9) AS average FROM long JOIN samples USING (session) WHERE v IS NOT NULL GROUP BY session, name
    """,
    "column_totals": " UNION ALL ".join(f"SELECT '{c}' AS name, round(sum({c})::DOUBLE, 2) AS total, max({c})::DOUBLE AS most FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "running_median": f"WITH {LOG} SELECT session, seq, round(median(value) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 63 PRECEDING AND CURRENT ROW), 9) AS median FROM log",
    "inventory_spread": f"""
        WITH {OUTCOMES}, sizes AS (SELECT environment, stratum, count(*) AS n FROM outcomes GROUP BY ALL),
        spread AS (SELECT environment, min(n) AS least, median(n)::DOUBLE AS median, max(n) AS most FROM sizes GROUP BY 1)
        SELECT environment, count(DISTINCT parent) AS items, count(DISTINCT stratum) AS parts, count(DISTINCT outcome) AS kinds, any_value(least) AS least, any_value(median) AS median, any_value(most) AS most
        FROM outcomes JOIN spread USING (environment) GROUP BY environment
    """,
    "salted_rounds": f"""
        WITH {OUTCOMES}, ranked AS (
            SELECT environment, stratum, parent, row_number() OVER (PARTITION BY environment, stratum ORDER BY sha256(concat_ws('|', 'pick-1', environment, stratum, parent)), parent) - 1 AS rank FROM outcomes
        )
        SELECT environment, stratum, parent, rank FROM ranked QUALIFY row_number() OVER (PARTITION BY environment ORDER BY rank, sha256(concat_ws('|', 'strata-1', environment, stratum)), stratum) <= 64
    """,
    "stale_spread": f"""
        WITH {LOG}, rows AS (SELECT *, utc_us // {BUCKET_S * 1_000_000} AS bucket FROM log),
        lost AS (SELECT session, bucket, sum(coalesce(k, 0)) AS stale FROM rows WHERE seq % 7 = 0 GROUP BY ALL HAVING sum(coalesce(k, 0)) > 0),
        marks AS (SELECT session, bucket, ev, count(*) OVER (PARTITION BY session, bucket) AS marks FROM rows WHERE seq % 7 <> 0)
        SELECT session, coalesce(ev, 'none') AS ev, round(sum(CASE WHEN marks IS NULL THEN stale::DOUBLE ELSE stale::DOUBLE / marks END), 6) AS share FROM lost LEFT JOIN marks USING (session, bucket) GROUP BY ALL
    """,
    "heaviest_names": f"""
        WITH {LOG}, sums AS (SELECT session, ev, round(sum(value), 6) AS s FROM log WHERE value IS NOT NULL GROUP BY ALL),
        shares AS (SELECT session, ev, round(s / nullif(sum(s) OVER (PARTITION BY session), 0), 9) AS share FROM sums)
        SELECT session, row_number() OVER (PARTITION BY session ORDER BY share DESC, ev) AS place, ev, share FROM shares WHERE share >= 0.05 QUALIFY place <= 5
    """,
    "remaining_pool": f"WITH {OUTCOMES} SELECT environment, count(*) AS pool, count(*) FILTER ({EARLIER}) AS earlier, count(*) FILTER (NOT ({EARLIER})) AS left_over FROM outcomes GROUP BY environment",
    "split_membership": f"""
        WITH {OUTCOMES}, t AS (SELECT *, ({TRAIN})::INT AS a, ({HELD_OUT})::INT AS b, ({EARLIER})::INT AS c FROM outcomes)
        SELECT environment, sum(a)::BIGINT AS train, sum(b)::BIGINT AS held_out, sum(c)::BIGINT AS earlier, count(*) FILTER (a + b + c > 1) AS several, count(*) FILTER (a + b + c = 0) AS unlisted FROM t GROUP BY environment
    """,
    "planning_estimate": "SELECT lang, count(*) AS requests, round(0.25::DOUBLE * count(*) + 0.001::DOUBLE * sum(length(coalesce(text, ''))), 6) AS seconds FROM documents GROUP BY lang",
}
