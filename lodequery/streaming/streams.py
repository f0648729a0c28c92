"""Structured Streaming: per-second telemetry with late data, requests processed once, detections joined into objects."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..binding import LOG, log


def seconds(events: DataFrame, late: str = "10 seconds", line: float = 50.0) -> DataFrame:
    """Tumbling seconds of each session by event time: rows, the maximum and those over the line; later rows than ``late`` are not counted."""
    timed = events.withColumn("ts", F.timestamp_micros("utc_us")).withWatermark("ts", late)
    return timed.groupBy("session", F.window("ts", "1 second")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("highest"), F.count_if(F.col("value") > line).alias("n_over"))


def once(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each request id once, as long as the repeat comes within ``late``; the state is bounded by the watermark."""
    return requests.withColumn("ts", F.timestamp_micros("utc_us")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])


def diverted(events: DataFrame, current: str = "epoch", wanted: int = 0) -> tuple[DataFrame, DataFrame]:
    """Events of the wanted epoch, and those of others with the reason they are set aside."""
    return events.filter(F.col(current) == wanted), events.filter(F.col(current) != wanted).withColumn("fate", F.lit("tracking_reset"))


class Tracker:
    """Objects of one scan: a detection joins the nearest object of its category in reach, else starts one; close ones merge."""

    def __init__(self, rows: list, reach: float, merge: float) -> None:
        self.objects, self.reach, self.merge = [list(r) for r in rows], reach, merge

    def add(self, frame: int, category: str, x: float, y: float, z: float) -> None:
        apart = lambda o: ((o[1] - x) ** 2 + (o[2] - y) ** 2 + (o[3] - z) ** 2) ** 0.5
        near = [(apart(o), i) for i, o in enumerate(self.objects) if o[0] == category and o[5] != frame and apart(o) <= self.reach]
        if not near:
            self.objects.append([category, x, y, z, 1, frame])
            return
        o = self.objects[min(near)[1]]
        n = o[4]
        o[1:6] = [(o[1] * n + x) / (n + 1), (o[2] * n + y) / (n + 1), (o[3] * n + z) / (n + 1), n + 1, frame]
        self.settle()

    def settle(self) -> None:
        """Merge pairs until none is close; the earlier object absorbs, and the search starts over after each merge."""
        again = True
        while again:
            again = False
            for i, a in enumerate(self.objects):
                for j in range(i + 1, len(self.objects)):
                    b = self.objects[j]
                    if a[0] == b[0] and sum((a[k] - b[k]) ** 2 for k in (1, 2, 3)) ** 0.5 <= self.merge:
                        n = a[4] + b[4]
                        a[1:6] = [*((a[k] * a[4] + b[k] * b[4]) / n for k in (1, 2, 3)), n, max(a[5], b[5])]
                        del self.objects[j]
                        again = True
                        break
                if again:
                    break


def associated(frames: DataFrame, reach: float = 0.8, merge: float = 0.2, least: int = 2) -> DataFrame:
    """(scan, index, category, x, y, z, seen, confirmed) of each scan's objects, brought up to date with every batch.

    ``frames`` has scan, frame, category, x, y, z. The state of a scan is its list of objects.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker(state.get[0] if state.exists else [], reach, merge)
        rows = pd.concat(list(batches)).sort_values(["frame", "category", "x", "y", "z"], kind="stable")
        for r in rows.itertuples(index=False):
            tracker.add(int(r.frame), r.category, float(r.x), float(r.y), float(r.z))
        state.update(([tuple(o) for o in tracker.objects],))
        yield pd.DataFrame([(key[0], i, o[0], o[1], o[2], o[3], o[4], o[4] >= least) for i, o in enumerate(tracker.objects)], columns=["scan", "index", "category", "x", "y", "z", "seen", "confirmed"])

    out = "scan bigint, index int, category string, x double, y double, z double, seen int, confirmed boolean"
    kept = "objects array<struct<category:string,x:double,y:double,z:double,seen:int,frame:int>>"
    return frames.groupBy("scan").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)


def q_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's seconds over the whole log at once."""
    return seconds(log(spark, sf_dir)).select("session", F.unix_micros("window.start").alias("second_us"), "n", "highest", "n_over")


def q_diverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a diversion of the log by its number k: what goes on, and what is set aside with its fate."""
    kept, aside = diverted(log(spark, sf_dir), "k", 3)
    both = kept.withColumn("fate", F.lit("kept")).unionByName(aside)
    return both.groupBy("session", "fate").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


QUERIES = {"stream_seconds": q_seconds, "stream_diverted": q_diverted}
SQL = {
    "stream_seconds": f"WITH {LOG} SELECT session, utc_us - utc_us % 1000000 AS second_us, count(*) AS n, max(value) AS highest, count(*) FILTER (value > 50) AS n_over FROM log GROUP BY ALL",
    "stream_diverted": f"WITH {LOG} SELECT session, CASE WHEN k = 3 THEN 'kept' ELSE 'tracking_reset' END AS fate, count(*) AS n, sum(seq)::BIGINT AS seqs FROM log WHERE k IS NOT NULL GROUP BY ALL",
}
