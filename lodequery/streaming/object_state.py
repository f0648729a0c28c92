"""Objects of a scan as the state of a stream: sightings join boxes, boxes merge to a fixpoint, and an object counts once enough frames saw it.

A sighting joins the smallest box it lies in, of its category or of one that joins with it, else the nearest object of its category in
reach, else it starts an object. Two sightings of one category in one frame are two objects: an object seen as that category in a frame
takes no second one of it, and objects with such a frame in common never merge. When a frame is complete, close objects merge, the earlier absorbing the later, until none are
close. An object's category is the one with most sightings (ties: the first by name).

Frames of a scan come in order. A frame is applied when a later one arrives, so the state after a batch does not depend on where batches end, and what a batch gives out is
what it would be if its last frame were complete. Rows of a frame that has been applied are counted as late and change nothing.

Edge cases: sightings with a null frame, category, place or size are counted as unusable. Rows that repeat are sightings of their own. State grows with the objects and frames of a
scan and with the sightings of its last frame.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..binding import read


@dataclass(frozen=True)
class Settings:
    """Margin of a box, reach of a category, frames that confirm, furniture (which joins furniture, also resting on it) and groups that join."""

    margin_m: float = 0.1
    top_m: float = 0.5
    reach_m: float = 0.3
    reach_factor: float = 0.5
    frames: int = 3
    furniture: tuple[str, ...] = ("bed", "chair", "couch", "table")
    groups: tuple[tuple[str, ...], ...] = (("bottle", "cup"), ("keyboard", "laptop"))

    def joins(self, a: str, b: str) -> bool:
        return a == b or any(a in g and b in g for g in (self.furniture, *self.groups))


class Thing:
    """One object: its box, how often it was seen as what, and in which frames."""

    def __init__(self, low: list[float], high: list[float]) -> None:
        self.low, self.high = list(low), list(high)
        self.votes: Counter[str] = Counter()
        self.seen: set[tuple[int, str]] = set()
        self.score = 0.0

    @property
    def category(self) -> str:
        return min(self.votes, key=lambda c: (-self.votes[c], c))

    @property
    def centre(self) -> list[float]:
        return [(a + b) / 2 for a, b in zip(self.low, self.high, strict=True)]

    @property
    def size(self) -> float:
        return max(b - a for a, b in zip(self.low, self.high, strict=True))

    @property
    def volume(self) -> float:
        return (self.high[0] - self.low[0]) * (self.high[1] - self.low[1]) * (self.high[2] - self.low[2])

    def outside(self, point: list[float], top: float) -> float:
        """How far a point is from the box, which reaches ``top`` higher than it is."""
        over = [max(a - p, p - b - (top if k == 2 else 0), 0.0) for k, (a, b, p) in enumerate(zip(self.low, self.high, point, strict=True))]
        return sum(x * x for x in over) ** 0.5

    def absorb(self, other: Thing) -> None:
        self.low, self.high = list(map(min, self.low, other.low)), list(map(max, self.high, other.high))
        self.votes.update(other.votes)
        self.seen |= other.seen
        self.score = max(self.score, other.score)

    def kept(self) -> list:
        return [self.low, self.high, sorted(self.votes.items()), sorted(self.seen), self.score]

    @classmethod
    def of(cls, kept: list) -> Thing:
        thing = cls(kept[0], kept[1])
        thing.votes, thing.seen, thing.score = Counter(dict(kept[2])), {(f, c) for f, c in kept[3]}, kept[4]
        return thing


def apart(a: list[float], b: list[float]) -> float:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5


class Scan:
    """The objects of one scan, and the sightings of the frame that may not be complete."""

    def __init__(self, settings: Settings, kept: str | None = None) -> None:
        self.settings = settings
        frame, objects, waiting, late, unusable = json.loads(kept) if kept else (None, [], [], 0, 0)
        self.frame, self.objects, self.waiting, self.late, self.unusable = frame, [Thing.of(x) for x in objects], [tuple(x) for x in waiting], late, unusable

    def text(self) -> str:
        return json.dumps([self.frame, [x.kept() for x in self.objects], self.waiting, self.late, self.unusable])

    def add(self, sightings: list[tuple]) -> None:
        """Take sightings (frame, detection, category, centre, size, score) in any order of their frames within one batch."""
        for row in sorted(sightings, key=lambda r: (r[0] is None, r[:2] if r[0] is not None else ())):
            if any(x is None or x != x for x in (row[0], row[2], *row[3], *row[4])):
                self.unusable += 1
            elif self.frame is not None and row[0] < self.frame:
                self.late += 1
            else:
                if self.frame is not None and row[0] > self.frame:
                    self.complete()
                self.frame = row[0]
                self.waiting.append(row)

    def complete(self) -> None:
        """Apply the waiting frame."""
        touched = {id(self.join(row)) for row in sorted(self.waiting, key=lambda r: (r[1], r[2], r[3], r[4]))}
        self.waiting = []
        self.merge(touched)

    def join(self, row: tuple) -> Thing:
        frame, _, category, centre, size, score = row
        one = Thing([c - s / 2 for c, s in zip(centre, size, strict=True)], [c + s / 2 for c, s in zip(centre, size, strict=True)])
        one.votes[category], one.score = 1, score or 0.0
        one.seen.add((frame, category))
        free = [o for o in self.objects if (frame, category) not in o.seen]
        top = self.settings.top_m if category in self.settings.furniture else 0.0
        around = [o for o in free if self.settings.joins(o.category, category) and o.outside(centre, top) <= self.settings.margin_m]
        near = [o for o in free if o.category == category and apart(o.centre, centre) <= self.reach(o, one)]
        best = min(around, key=lambda o: o.volume) if around else min(near, key=lambda o: apart(o.centre, centre)) if near else None
        if best is None:
            self.objects.append(one)
            return one
        best.absorb(one)
        return best

    def reach(self, a: Thing, b: Thing) -> float:
        return max(self.settings.reach_m, self.settings.reach_factor * max(a.size, b.size))

    def close(self, a: Thing, b: Thing) -> bool:
        if not a.seen.isdisjoint(b.seen) or not self.settings.joins(a.category, b.category):
            return False
        top = self.settings.top_m if a.category in self.settings.furniture and b.category in self.settings.furniture else 0.0
        if min(a.outside(b.centre, top), b.outside(a.centre, top)) <= self.settings.margin_m:
            return True
        return a.category == b.category and apart(a.centre, b.centre) <= self.reach(a, b)

    def merge(self, touched: set[int]) -> None:
        """Merge the first close pair, by order of age, until there is none. Pairs of which neither has changed since the last time are not close."""
        while True:
            n = len(self.objects)
            pair = next(((i, j) for i in range(n) for j in range(i + 1, n) if (id(self.objects[i]) in touched or id(self.objects[j]) in touched) and self.close(self.objects[i], self.objects[j])), None)
            if pair is None:
                return
            self.objects[pair[0]].absorb(self.objects[pair[1]])
            touched.add(id(self.objects[pair[0]]))
            del self.objects[pair[1]]

    def rows(self) -> list[tuple]:
        """The objects as they are once the waiting frame is applied, which happens to a copy."""
        copy = Scan(self.settings, self.text())
        copy.complete()
        out = []
        for i, o in enumerate(copy.objects):
            frames = len({f for f, _ in o.seen})
            out.append((i, o.category, *o.low, *o.high, sum(o.votes.values()), frames, frames >= self.settings.frames, o.score, self.late, self.unusable))
        return out


COLUMNS = ["object", "category", "x_min", "y_min", "z_min", "x_max", "y_max", "z_max", "sightings", "frames", "confirmed", "score", "late", "unusable"]
OUT = "scan bigint, object int, category string, x_min double, y_min double, z_min double, x_max double, y_max double, z_max double, sightings bigint, frames bigint, confirmed boolean, score double, late bigint, unusable bigint"
WANTED = ["scan", "frame", "detection", "category", "x", "y", "z", "sx", "sy", "sz", "score"]


def sightings_of(group: pd.DataFrame) -> list[tuple]:
    none = lambda v: None if v is None or v != v else v
    whole = lambda v: None if none(v) is None else int(v)
    return [(whole(r.frame), whole(r.detection) or 0, none(r.category), [none(r.x), none(r.y), none(r.z)], [none(r.sx), none(r.sy), none(r.sz)], none(r.score)) for r in group.itertuples(index=False)]


def tracked(sightings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The objects of every scan with new sightings, after each batch of the stream."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scan = Scan(settings, state.get[0] if state.exists else None)
        scan.add([row for batch in batches for row in sightings_of(batch)])
        state.update((scan.text(),))
        yield pd.DataFrame([(key[0], *row) for row in scan.rows()], columns=["scan", *COLUMNS])

    return sightings.select(*WANTED).groupBy("scan").applyInPandasWithState(step, OUT, "state string", "update", GroupStateTimeout.NoTimeout)


def replayed(sightings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The objects of every scan of a table: what the stream comes to, in one pass."""

    def whole(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        scan = Scan(settings)
        scan.add(sightings_of(group))
        return pd.DataFrame([(key[0], *row) for row in scan.rows()], columns=["scan", *COLUMNS])

    return sightings.select(*WANTED).groupBy("scan").applyInPandas(whole, OUT)


def scan_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as sightings: a scan is a block of 500 vectors, a frame some of them, places and sizes are their numbers."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    kind = F.element_at(F.array(*map(F.lit, ("table", "chair", "cup", "bottle", "lamp"))), (F.col("label") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 500).alias("scan"), F.floor(F.col("vec_id") % 500 / 8).alias("frame"), F.col("vec_id").alias("detection"), kind.alias("category"),
        *[(6 * e(i + 1)).alias(c) for i, c in enumerate("xyz")], *[(0.2 + F.abs(e(i + 4))).alias(f"s{c}") for i, c in enumerate("xyz")], F.abs(e(7)).alias("score"),
    )


def q_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(scan_sightings(spark, sf_dir))


QUERIES = {"object_states": q_objects}
SQL: dict[str, str] = {}
