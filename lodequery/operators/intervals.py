"""Joins in time: overlap, existence, nearest, greedy as-of, start/end pairing, range expansion, and pieces with gaps.

Overlap joins meet on time bins: an interval is entered once for each bin it touches, so the join is an equi-join on
(session, bin) and never all pairs of a session; a pair is counted in the first bin both touch.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import LOG, log

HOUR = 3_600_000_000
BIN = 24 * HOUR


def in_bins(df: DataFrame, start: str, end: str, width: int = BIN) -> DataFrame:
    """A row for each bin that [start, end) touches, with the bin."""
    last = F.greatest(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / width), last)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Pairs of rows (columns l_start, l_end and r_start, r_end) that overlap, and by how much."""
    meet = in_bins(left, "l_start", "l_end", width).join(in_bins(right, "r_start", "r_end", width), [*keys, "bin"])
    common = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    return meet.withColumn("overlap", common).filter((F.col("overlap") > 0) & (F.floor(F.greatest("l_start", "r_start") / width) == F.col("bin"))).drop("bin")


def paired_intervals(events: DataFrame, start: str, end: str, key: str = "session") -> DataFrame:
    """(key, r_start, r_end): each start event to the next end event; a second start before it replaces the first."""
    order = Window.partitionBy(key).orderBy("utc_us", "event_id")
    marks = events.filter(F.col("ev").isin(start, end)).select(key, "utc_us", "event_id", "ev")
    nxt = marks.withColumn("next_ev", F.lead("ev").over(order)).withColumn("next_us", F.lead("utc_us").over(order))
    return nxt.filter((F.col("ev") == start) & (F.col("next_ev") == end)).select(key, F.col("utc_us").alias("r_start"), F.col("next_us").alias("r_end"))


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For each left row (t, left_id) the right row nearest in time; a tie takes the earlier. One sort, no pairs."""
    both = left.select(*keys, "t", "left_id", F.lit(None).cast("struct<t:bigint,id:bigint>").alias("mark")).unionByName(right.select(*keys, "t", F.lit(None).cast("bigint").alias("left_id"), F.struct("t", F.col("right_id").alias("id")).alias("mark")))
    order = Window.partitionBy(*keys).orderBy("t", F.col("left_id").isNotNull(), F.col("mark.id"))
    back = F.last("mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("mark", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumn("back", back).withColumn("ahead", ahead).filter(F.col("left_id").isNotNull())
    take = F.when(F.col("ahead").isNull() | (F.col("t") - F.col("back.t") <= F.col("ahead.t") - F.col("t")), F.col("back")).otherwise(F.col("ahead"))
    return seen.withColumn("near", take).select(*keys, "left_id", F.col("near.id").alias("right_id"), F.abs(F.col("near.t") - F.col("t")).alias("apart"))


def greedy_as_of(left: DataFrame, right: DataFrame, keys: list[str], id_type: str = "bigint") -> DataFrame:
    """Each left row, in order of time, takes the first later right row of its keys that none before it took.

    Because earlier rows take earlier matches, the walk needs only a queue of the left rows still unmatched. The rows
    of a key are worked through in one task.
    """
    both = left.select(*keys, "t", F.lit(0).alias("side"), F.col("left_id").alias("own")).unionByName(right.select(*keys, "t", F.lit(1).alias("side"), F.col("right_id").alias("own")))
    types = dict(both.dtypes)

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        waiting, out = deque(), []
        for row in group.sort_values(["t", "side", "own"], kind="stable").itertuples(index=False):
            if row.side == 0:
                waiting.append(row)
            elif waiting and waiting[0].t <= row.t:
                first = waiting.popleft()
                out.append((*[getattr(first, k) for k in keys], first.own, row.own, row.t - first.t))
        out += [(*[getattr(w, k) for k in keys], w.own, None, None) for w in waiting]
        frame = pd.DataFrame(out, columns=[*keys, "left_id", "right_id", "waited"])
        return frame.astype({"right_id": "Int64", "waited": "Int64"})

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", left_id {id_type}, right_id {id_type}, waited bigint"
    return both.groupBy(*keys).applyInPandas(walk, schema)


def expanded(df: DataFrame, start: str, end: str, step: int) -> DataFrame:
    """A row for each step of the closed range; later rows of a step win by ``order``."""
    return df.withColumn("step", F.explode(F.sequence(F.floor(F.col(start) / step), F.floor(F.col(end) / step))))


def q_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired_intervals(log(spark, sf_dir), "click", "view")


def buckets(events: DataFrame) -> DataFrame:
    hour = F.floor(F.col("utc_us") / HOUR)
    return events.groupBy("session", hour.alias("hour")).agg(F.count(F.lit(1)).alias("n")).select("session", (F.col("hour") * HOUR).alias("l_start"), ((F.col("hour") + 1) * HOUR).alias("l_end"), "n")


def q_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = log(spark, sf_dir)
    found = overlap_join(buckets(events), paired_intervals(events, "click", "view"), ["session"])
    return found.groupBy("session", "l_start").agg(F.sum("overlap").alias("overlap_us"), F.count(F.lit(1)).alias("n_intervals"))


def q_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside no interval of their session."""
    events = log(spark, sf_dir)
    moments = events.select("session", "event_id", F.col("utc_us").alias("l_start"), (F.col("utc_us") + 1).alias("l_end"))
    inside = overlap_join(moments, paired_intervals(events, "click", "view"), ["session"]).select("event_id").distinct()
    return events.join(inside, "event_id", "left_anti").groupBy("session").agg(F.count(F.lit(1)).alias("n_outside"))


def q_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = log(spark, sf_dir)
    left = events.filter("ev = 'purchase'").select("session", F.col("utc_us").alias("t"), F.col("event_id").alias("left_id"))
    right = events.filter("ev = 'view'").select("session", F.col("utc_us").alias("t"), F.col("event_id").alias("right_id"))
    return nearest_join(left, right, ["session"])


def q_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = log(spark, sf_dir)
    left = events.filter("ev = 'click'").select("session", F.col("utc_us").alias("t"), F.col("event_id").alias("left_id"))
    right = events.filter("ev = 'purchase'").select("session", F.col("utc_us").alias("t"), F.col("event_id").alias("right_id"))
    return greedy_as_of(left, right, ["session"])


def q_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours a session's intervals cover, each with the latest interval that covers it."""
    spans = expanded(paired_intervals(log(spark, sf_dir), "click", "view"), "r_start", "r_end", HOUR)
    return spans.groupBy("session", "step").agg(F.max_by("r_end", "r_start").alias("latest_end"), F.count(F.lit(1)).alias("n_intervals"))


PAIRS = f"""
    {LOG}, marks AS (
        SELECT session, utc_us, ev, lead(ev) OVER w AS next_ev, lead(utc_us) OVER w AS next_us FROM log WHERE ev IN ('click', 'view') WINDOW w AS (PARTITION BY session ORDER BY utc_us, event_id)
    ), spans AS (SELECT session, utc_us AS r_start, next_us AS r_end FROM marks WHERE ev = 'click' AND next_ev = 'view')
"""
QUERIES = {"paired_intervals": q_pairs, "interval_overlap": q_overlap, "interval_anti": q_outside, "nearest_join": q_nearest, "greedy_as_of": q_as_of, "expand_range": q_expand}
SQL = {
    "paired_intervals": f"WITH {PAIRS} SELECT * FROM spans",
    "interval_overlap": f"""
        WITH {PAIRS}, hours AS (SELECT DISTINCT session, (utc_us // {HOUR}) * {HOUR} AS l_start FROM log)
        SELECT session, l_start, sum(least(r_end, l_start + {HOUR}) - greatest(r_start, l_start))::BIGINT AS overlap_us, count(*) AS n_intervals
        FROM hours JOIN spans USING (session) WHERE r_start < l_start + {HOUR} AND r_end > l_start AND least(r_end, l_start + {HOUR}) > greatest(r_start, l_start) GROUP BY ALL
    """,
    "interval_anti": f"WITH {PAIRS} SELECT session, count(*) AS n_outside FROM log l WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.session = l.session AND l.utc_us >= s.r_start AND l.utc_us < s.r_end) GROUP BY session",
    "nearest_join": f"""
        WITH {LOG}, near AS (
            SELECT p.session, p.event_id AS left_id, v.event_id AS right_id, abs(v.utc_us - p.utc_us) AS apart,
                   row_number() OVER (PARTITION BY p.event_id ORDER BY abs(v.utc_us - p.utc_us), v.utc_us, CASE WHEN v.utc_us <= p.utc_us THEN -v.event_id ELSE v.event_id END) AS n
            FROM log p LEFT JOIN log v ON p.session = v.session AND v.ev = 'view' WHERE p.ev = 'purchase'
        )
        SELECT session, left_id, right_id, apart FROM near WHERE n = 1
    """,
    "expand_range": f"""
        WITH {PAIRS}, steps AS (SELECT *, unnest(range(r_start // {HOUR}, r_end // {HOUR} + 1)) AS step FROM spans)
        SELECT session, step, arg_max(r_end, r_start) AS latest_end, count(*) AS n_intervals FROM steps GROUP BY ALL
    """,
}
