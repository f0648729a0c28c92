"""Event logs and metric series: integrity, gaps, rates, calibration, percentiles, per-second windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import LOG, log

SECOND = 1_000_000


def integrity(events: DataFrame, key: str = "session") -> DataFrame:
    """Counts of faults for each log: sequence gaps and steps back, clock steps back, wrong start, events after the end."""
    order = Window.partitionBy(key).orderBy("line")
    step = F.col("seq") - F.lag("seq").over(order)
    ended = F.max((F.col("ev") == "session.end").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.select(
        key,
        (step > 1).cast("int").alias("gap"),
        (step <= 0).cast("int").alias("back"),
        (F.col("mono_us") < F.lag("mono_us").over(order)).cast("int").alias("clock"),
        ((F.row_number().over(order) == 1) & ((F.col("seq") != 0) | (F.col("ev") != "session.start"))).cast("int").alias("start"),
        F.coalesce(ended, F.lit(0)).alias("late"),
        (F.col("ev") == "session.end").cast("int").alias("end"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.groupBy(key).agg(total("gap").alias("n_gaps"), total("back").alias("n_back"), total("clock").alias("n_clock_back"), total("start").alias("bad_start"), total("late").alias("n_after_end"), (F.max("end") == 0).alias("missing_end"))


def at_rank(value: str, order: list[str], keys: list[str], rank: Column, df: DataFrame, out: str) -> DataFrame:
    """The value at an exact position (1-based, from the group's count ``n``) of each group's order."""
    w = Window.partitionBy(*keys)
    numbered = df.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(w))
    return numbered.filter(F.col("_k") == rank).select(*keys, F.col(value).alias(out))


def percentiles(df: DataFrame, value: str, keys: list[str], percent: int) -> DataFrame:
    """A percentile by the five conventions for positions, and the median of two middles, of each group.

    nearest: ceil(p n) in whole numbers; half_even and half_away: p (n - 1) rounded either way; low: the
    lower middle; median: the mean of the middles. They differ, and are not to be merged.
    """
    w = Window.partitionBy(*keys)
    numbered = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"), F.row_number().over(w.orderBy(value)).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    place = F.lit(percent) * (F.col("n") - 1) / 100
    pick = lambda rank, name: F.max(F.when(F.col("k") == rank, F.col("v"))).alias(name)
    nearest = F.greatest(F.lit(1), F.floor((F.lit(percent) * F.col("n") + 99) / 100))
    return numbered.groupBy(*keys).agg(
        F.max("n").alias("n"),
        pick(nearest, "nearest"),
        pick(F.bround(place, 0).cast("bigint") + 1, "half_even"),
        pick(F.round(place, 0).cast("bigint") + 1, "half_away"),
        pick(F.floor((F.col("n") + 1) / 2), "low"),
        F.round(F.avg(F.when(F.col("k").isin(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)), F.col("v"))), 6).alias("median"),
    )


def frames_per_gap(events: DataFrame, key: str, t: str, longest: float = 3.0) -> DataFrame:
    """Rate over time with empty seconds counted: a gap above ``longest`` seconds adds its missing seconds."""
    order = Window.partitionBy(key).orderBy(t, "event_id")
    gap = (F.col(t) - F.lag(t).over(order)) / SECOND
    missing = F.when(gap > longest, F.floor(gap + 0.5) - 1).otherwise(0)
    rows = events.select(key, gap.alias("gap"), missing.alias("missing"), "value")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("missing").cast("bigint").alias("n_missing"), F.count_if(F.col("gap") > longest).alias("n_gaps"), F.round(F.sum("value") / (F.count(F.lit(1)) + F.sum("missing")), 9).alias("rate"))


def correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson's r of each group; null for fewer than three rows or a constant."""
    n, sx, sy = F.count(F.lit(1)), F.stddev_pop(x), F.stddev_pop(y)
    stats = df.groupBy(*keys).agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), F.covar_pop(x, y).alias("c"))
    return stats.select(*keys, "n", F.when((F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.round(F.col("c") / (F.col("sx") * F.col("sy")), 6)).alias("r"))


def best_shift(left: DataFrame, right: DataFrame, shifts: range) -> DataFrame:
    """The shift (in bins) of ``right`` at which its counts correlate best with ``left``; ties take the smallest shift.

    Both are (bin, n); only the bins, aggregated beforehand, are crossed with the shifts.
    """
    moved = right.withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).select((F.col("bin") + F.col("shift")).alias("bin"), "shift", F.col("n").alias("m"))
    every = left.withColumn("shift", F.explode(F.array(*map(F.lit, shifts))))
    both = every.join(moved, ["bin", "shift"], "left").fillna(0, ["m"])
    return correlation(both, ["shift"], "n", "m").orderBy(F.desc_nulls_last("r"), "shift")


def tumbling(events: DataFrame, keys: list[str], seconds: int, line: float) -> DataFrame:
    """Counts by window of so many seconds: rows, the maximum, those over the line, and the longest run of them."""
    bucket = F.floor(F.col("utc_us") / (seconds * SECOND)).alias("bucket")
    order = Window.partitionBy(*keys, "bucket").orderBy("utc_us", "event_id")
    marked = events.select(*keys, bucket, "utc_us", "event_id", "value", (F.col("value") > line).alias("over"))
    runs = marked.withColumn("run", F.sum((~F.col("over")).cast("int")).over(order))
    sized = runs.withColumn("length", F.sum(F.col("over").cast("int")).over(Window.partitionBy(*keys, "bucket", "run")))
    return sized.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("highest"), F.count_if("over").alias("n_over"), F.max("length").cast("bigint").alias("longest_run"))


def as_log(events: DataFrame) -> DataFrame:
    """The driver's events with some faults: numbers skip every 97th event and clocks follow the value."""
    seq = F.col("seq") + F.when(F.col("event_id") % 97 == 0, 2).otherwise(0)
    name = F.when(F.col("seq") == 0, "session.start").when(F.col("event_id") % 501 == 0, "session.end").otherwise(F.col("ev"))
    return events.select("session", F.col("seq").alias("line"), seq.alias("seq"), (F.col("utc_us") - F.when(F.col("k") == 7, 10 * 3600 * SECOND).otherwise(0)).alias("mono_us"), name.alias("ev"))


def q_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity(as_log(log(spark, sf_dir)))


def q_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(log(spark, sf_dir), "value", ["ev"], 7)


def q_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_per_gap(log(spark, sf_dir), "session", "utc_us")


def q_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation(log(spark, sf_dir).withColumn("x", F.col("k").cast("double")), ["ev"], "x", "value")


def q_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = lambda ev: log(spark, sf_dir).filter(F.col("ev") == ev).groupBy(F.floor(F.col("utc_us") / (86400 * SECOND)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return best_shift(bins("click"), bins("purchase"), range(-3, 4)).select("shift", "n", "r")


def q_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(log(spark, sf_dir), ["session"], 86400, 50.0)


def q_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span of each session, its first and last event, and the split of the first request from the rest."""
    events = log(spark, sf_dir)
    order = F.struct("utc_us", "event_id")
    return events.groupBy("session").agg(F.min_by("ev", order).alias("first_ev"), F.max_by("ev", order).alias("last_ev"), (F.max("utc_us") - F.min("utc_us")).alias("span_us"), F.round(F.min_by("value", order), 6).alias("cold"), F.round(F.avg(F.when(F.col("seq") > 0, F.col("value"))), 6).alias("warm"))


_pick = "max(CASE WHEN k = {r} THEN v END)"
QUERIES = {"log_integrity": q_integrity, "percentile_conventions": q_percentiles, "gap_aware_rate": q_rates, "guarded_correlation": q_correlation, "calibration_shift": q_shift, "tumbling_runs": q_tumbling, "session_first_last": q_first_last}
SQL = {
    "log_integrity": f"""
        WITH {LOG}, faulty AS (
            SELECT session, seq AS line, seq + CASE WHEN event_id % 97 = 0 THEN 2 ELSE 0 END AS seq, utc_us - CASE WHEN k = 7 THEN 36000000000 ELSE 0 END AS mono_us,
                   CASE WHEN seq = 0 THEN 'session.start' WHEN event_id % 501 = 0 THEN 'session.end' ELSE ev END AS ev FROM log
        ), seen AS (
            SELECT *, seq - lag(seq) OVER w AS step, mono_us < lag(mono_us) OVER w AS clock, max((ev = 'session.end')::INT) OVER (PARTITION BY session ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late,
                   row_number() OVER w AS k FROM faulty WINDOW w AS (PARTITION BY session ORDER BY line)
        )
        SELECT session, count(*) FILTER (step > 1) AS n_gaps, count(*) FILTER (step <= 0) AS n_back, count(*) FILTER (clock) AS n_clock_back, count(*) FILTER (k = 1 AND (seq <> 0 OR ev <> 'session.start')) AS bad_start,
               count(*) FILTER (late = 1) AS n_after_end, count(*) FILTER (ev = 'session.end') = 0 AS missing_end
        FROM seen GROUP BY session
    """,
    "percentile_conventions": f"""
        WITH {LOG}, r AS (SELECT ev, value AS v, row_number() OVER (PARTITION BY ev ORDER BY value) AS k, count(*) OVER (PARTITION BY ev) AS n FROM log WHERE value IS NOT NULL)
        SELECT ev, max(n) AS n, {_pick.format(r='greatest(1, (7 * n + 99) // 100)')} AS nearest, {_pick.format(r='round_even(7 * (n - 1) / 100.0, 0)::BIGINT + 1')} AS half_even, {_pick.format(r='round(7 * (n - 1) / 100.0)::BIGINT + 1')} AS half_away,
               {_pick.format(r='(n + 1) // 2')} AS low, round(median(v), 6) AS median FROM r GROUP BY ev
    """,
    "gap_aware_rate": f"""
        WITH {LOG}, g AS (SELECT session, value, (utc_us - lag(utc_us) OVER (PARTITION BY session ORDER BY utc_us, event_id)) / 1000000.0::DOUBLE AS gap FROM log)
        SELECT session, count(*) AS n, sum(CASE WHEN gap > 3 THEN floor(gap + 0.5)::BIGINT - 1 ELSE 0 END)::BIGINT AS n_missing, count(*) FILTER (gap > 3) AS n_gaps,
               round(sum(value) / (count(*) + sum(CASE WHEN gap > 3 THEN floor(gap + 0.5)::BIGINT - 1 ELSE 0 END)), 9) AS rate FROM g GROUP BY session
    """,
    "guarded_correlation": f"WITH {LOG} SELECT ev, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(k) > 0 AND stddev_pop(value) > 0 THEN round(corr(k, value), 6) END AS r FROM log GROUP BY ev",
    "calibration_shift": f"""
        WITH {LOG}, a AS (SELECT utc_us // 86400000000 AS bin, count(*) AS n FROM log WHERE ev = 'click' GROUP BY 1), b AS (SELECT utc_us // 86400000000 AS bin, count(*) AS n FROM log WHERE ev = 'purchase' GROUP BY 1),
        s AS (SELECT unnest(range(-3, 4))::INT AS shift), j AS (SELECT s.shift, a.n AS x, coalesce(b.n, 0) AS y FROM a CROSS JOIN s LEFT JOIN b ON b.bin + s.shift = a.bin)
        SELECT shift, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS r FROM j GROUP BY shift
    """,
    "tumbling_runs": f"""
        WITH {LOG}, m AS (SELECT session, utc_us // 86400000000 AS bucket, utc_us, event_id, value, value > 50 AS over FROM log),
        r AS (SELECT *, sum((NOT over)::INT) OVER (PARTITION BY session, bucket ORDER BY utc_us, event_id) AS run FROM m),
        z AS (SELECT *, sum(over::INT) OVER (PARTITION BY session, bucket, run) AS length FROM r)
        SELECT session, bucket, count(*) AS n, max(value) AS highest, count(*) FILTER (over) AS n_over, max(length)::BIGINT AS longest_run FROM z GROUP BY ALL
    """,
    "session_first_last": f"""
        WITH {LOG} SELECT session, arg_min(ev, (utc_us, event_id)) AS first_ev, arg_max(ev, (utc_us, event_id)) AS last_ev, max(utc_us) - min(utc_us) AS span_us,
               round(arg_min(value, (utc_us, event_id)), 6) AS cold, round(avg(value) FILTER (seq > 0), 6) AS warm FROM log GROUP BY session
    """,
}
