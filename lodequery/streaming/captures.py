"""Keyframes of a head's samples as a stateful stream: taken when the head is steady at a new place or a new direction."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..binding import log


@dataclass(frozen=True)
class Rule:
    """Seconds and bounds of a steady head, turn and margin to the next direction, distance to the next place, most frames and places."""

    steady_s: float = 0.5
    steady_deg: float = 3.0
    steady_m: float = 0.05
    turn_deg: float = 30.0
    margin_deg: float = 5.0
    place_m: float = 1.5
    frames: int = 12
    places: int = 4


OUT = "scan bigint, t double, place int, step int, yaw double, reason string"
KEPT = "place int, x double, y double, yaws array<double>, recent array<struct<t:double,yaw:double,x:double,y:double>>"


def turn(degrees: float) -> float:
    """An angle in (-180, 180]."""
    rest = degrees % 360.0
    return rest - 360.0 if rest > 180 else rest


def moved(a: tuple, b: tuple) -> float:
    return ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5


class Capture:
    """What a scan keeps between samples: its place, where that began, the directions taken there and the recent samples."""

    def __init__(self, rule: Rule, place: int = -1, x: float = 0.0, y: float = 0.0, yaws: list | None = None, recent: list | None = None) -> None:
        self.rule, self.place, self.origin, self.yaws, self.recent = rule, place, (x, y), list(yaws or []), [tuple(r) for r in recent or []]

    def steady(self) -> bool:
        t, yaw, *at = self.recent[-1]
        if t - self.recent[0][0] < self.rule.steady_s or any(moved(r[2:], at) > self.rule.steady_m for r in self.recent):
            return False
        turns = [turn(r[1] - yaw) for r in self.recent]
        return max(turns) - min(turns) <= self.rule.steady_deg

    def due(self) -> str | None:
        """Why a keyframe is due, place before direction; nothing when none is."""
        _, yaw, *at = self.recent[-1]
        if self.place < 0 or (moved(at, self.origin) >= self.rule.place_m and self.place + 1 < self.rule.places):
            return "place"
        return "direction" if self.turned(yaw) else None

    def turned(self, yaw: float) -> bool:
        return len(self.yaws) < self.rule.frames and min((abs(turn(yaw - y)) for y in self.yaws), default=360.0) >= self.rule.turn_deg - self.rule.margin_deg

    def add(self, t: float, yaw: float, x: float, y: float, tracked: bool, busy: bool) -> tuple | None:
        """(place, step, reason) of the keyframe that this sample gives; while busy it is refused, not queued."""
        if not tracked:
            self.recent = []
            return None
        self.recent.append((t, yaw, x, y))
        while len(self.recent) > 2 and t - self.recent[1][0] >= self.rule.steady_s:
            self.recent.pop(0)
        reason = self.due() if self.steady() else None
        if reason is None:
            return None
        if busy:
            return self.place, len(self.yaws), "refused"
        if reason == "place":
            self.place, self.origin, self.yaws = self.place + 1, (x, y), []
        self.yaws.append(yaw)
        return self.place, len(self.yaws) - 1, reason


def frames_of(capture: Capture, scan: int, samples: pd.DataFrame) -> pd.DataFrame:
    """The keyframes that further samples of a scan give."""
    out = []
    for r in samples.sort_values("t", kind="stable").itertuples(index=False):
        taken = capture.add(float(r.t), float(r.yaw), float(r.x), float(r.y), bool(r.tracked), bool(r.busy))
        if taken:
            out.append((scan, float(r.t), taken[0], taken[1], float(r.yaw), taken[2]))
    return pd.DataFrame(out, columns=["scan", "t", "place", "step", "yaw", "reason"])


def keyframes(samples: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(scan, t, place, step, yaw, reason) of each keyframe taken, and of those refused while the last one was busy.

    ``samples`` has scan, t, yaw, x, y, tracked, busy. A scan's state is bounded: the samples of the steady window and at
    most ``rule.frames`` directions. Samples of a scan are taken in order of t within a batch; batches must follow in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        capture = Capture(rule, *state.get) if state.exists else Capture(rule)
        out = frames_of(capture, key[0], pd.concat(list(batches)))
        state.update((capture.place, *map(float, capture.origin), capture.yaws, capture.recent))
        yield out

    return samples.groupBy("scan").applyInPandasWithState(step, OUT, KEPT, "append", GroupStateTimeout.NoTimeout)


def replayed(samples: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The keyframes of all scans of a table: what the stream comes to, in one pass."""
    return samples.groupBy("scan").applyInPandas(lambda key, group: frames_of(Capture(rule), key[0], group), OUT)


def q_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as samples of heads: a session is a scan, its number k a direction, its value a place; a step is a tenth of a second."""
    samples = log(spark, sf_dir).select(F.col("session").alias("scan"), (F.col("seq") / 10).alias("t"), (F.floor(F.col("seq") / 8) * 35 % 360).cast("double").alias("yaw"), (F.floor(F.col("seq") / 40) * 1.6).alias("x"), F.lit(0.0).alias("y"), (F.coalesce("value", F.lit(0.0)) < 95).alias("tracked"), (F.col("ev") == "purchase").alias("busy"))
    return replayed(samples)


QUERIES = {"keyframes_replayed": q_keyframes}
SQL: dict[str, str] = {}
