"""Objects of a scan from its detections: rays, distances from size priors, sightings, tracks over standing positions, and objects.

A detection becomes a ray of the scene, by its box's centre and the camera's full pose. Size priors of its category give an interval of distance, the union over several
priors. At one standing position the rays of a category that point the same way form a sighting. Sightings join tracks position by position, by
minimum-cost assignment of gaps between rays; near ties are left unmade and both sides marked as possible duplicates; a track's point is fitted again after each
position and a ray too far from it is split off. A track seen from one position may join a fitted one that its rays pass.

Spark deals the work: rays and fates are columns, distances are solved in Arrow batches, sightings are formed by scan, position and category, tracks by
scan and category (rays of different categories never link, so the assignment falls apart there), and objects are numbered by a
window over the few tracks of a scan. What a task holds is one category of one scan.

Edge cases: a detection with a null label, score, box or pose is left out as ``unmapped_label``, ``below_min_score``, ``cut_by_the_edge`` or ``unusable_pose``,
whichever comes first. Rows that repeat are detections of their own. An empty table gives no objects. A zero direction or quaternion is an unusable pose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import read
from .matching import assigned

# Fixed values of the localization's settings.
MIN_SCORE, EDGE_PX, SAME_DEG, RANGE_TOLERANCE, GAP, PARALLAX_DEG, RIVAL, FAR = 0.3, 4.0, 6.0, 0.15, 0.25, 4.0, 1.5, 8.0
ATTACH_MARGIN, ATTACH_REACH, LEAST_COST, LEAST_OFF, SINGULAR = 0.25, 1.25, 0.01, 0.05, 1e-9
# Fixed values of the size prior: nearest distance, bisection steps, turns of the box, nearest depth before the camera.
NEAR, STEPS, TURNS, NEAREST_DEPTH = 0.3, 40, 6, 0.05

POSE = [f"r{i}{j}" for i in range(3) for j in range(3)]
RAY = ["ox", "oy", "oz", "dx", "dy", "dz"]


def observed(detections: DataFrame) -> DataFrame:
    """Each detection with its fate, the camera's rotation r00..r22 into the scene, and the ray from ox.. along dx...

    Wanted: scan, keyframe, position, detection, time_us, label, category (null if not mapped), score, x1, y1, x2, y2, width, height, fx, fy, cx, cy, and the pose px..pz, qx..qw
    as the tracker gives it (left-handed, y up). The scene's axes are the tracker's with y and z exchanged; the camera's y points down.
    """
    norm = F.sqrt(sum((F.col(f"q{s}") * F.col(f"q{s}") for s in "yzw"), F.col("qx") * F.col("qx")))
    pixel = {"_across": ((F.col("x1") + F.col("x2")) / 2 - 0.5 - F.col("cx")) / F.col("fx"), "_down": ((F.col("y1") + F.col("y2")) / 2 - 0.5 - F.col("cy")) / F.col("fy")}
    based = detections.select("*", *[F.try_divide(F.col(f"q{s}"), norm).alias(f"_{s}") for s in "xyzw"], *[c.alias(n) for n, c in pixel.items()], F.col("px").alias("ox"), F.col("pz").alias("oy"), F.col("py").alias("oz"))
    x, y, z, w = (F.col(f"_{s}") for s in "xyzw")
    m = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    posed = based.select("*", *[(-m[row][j] if j == 1 else m[row][j]).alias(f"r{i}{j}") for i, row in enumerate((0, 2, 1)) for j in range(3)]).drop(*[f"_{s}" for s in "xyzw"])
    turned = posed.select("*", *[(F.col(f"r{i}0") * F.col("_across") + F.col(f"r{i}1") * F.col("_down") + F.col(f"r{i}2")).alias(f"_a{i}") for i in range(3)]).drop(*pixel)
    along = [F.col(f"_a{i}") for i in range(3)]
    length = F.sqrt(along[0] * along[0] + along[1] * along[1] + along[2] * along[2])
    aimed = turned.select("*", *[F.try_divide(c, length).alias(f"d{s}") for c, s in zip(along, "xyz", strict=True)]).drop("_a0", "_a1", "_a2")
    whole = (F.col("x1") > EDGE_PX) & (F.col("y1") > EDGE_PX) & (F.col("x2") < F.col("width") - EDGE_PX) & (F.col("y2") < F.col("height") - EDGE_PX)
    usable = F.col("ox").isNotNull() & F.col("oy").isNotNull() & F.col("oz").isNotNull() & F.col("dx").isNotNull()
    sure = lambda c: F.coalesce(c, F.lit(False))
    fate = F.when(F.col("label").isNull() | F.col("category").isNull(), "unmapped_label").when(~sure(F.col("score") >= MIN_SCORE), "below_min_score").when(~sure(whole), "cut_by_the_edge").when(~sure(usable), "unusable_pose").otherwise("kept")
    return aimed.withColumn("fate", fate)


def heights(r: np.ndarray, pose: np.ndarray, direction: np.ndarray, size: np.ndarray, yaw: float, fy: np.ndarray) -> np.ndarray:
    """Projected heights, in pixels, of upright boxes at distances r along their rays; infinite for one that reaches the camera."""
    c, s = np.cos(yaw), np.sin(yaw)
    top, bottom, behind = np.full(len(r), np.inf), np.full(len(r), -np.inf), np.zeros(len(r), bool)
    for corner in range(8):
        x, y, z = ((0.5 if corner >> k & 1 else -0.5) * size[:, k] for k in range(3))
        at = r[:, None] * direction + np.stack([c * x - s * y, s * x + c * y, z], 1)
        down, depth = (np.einsum("nx,nx->n", at, pose[:, :, k]) for k in (1, 2))
        close = depth < NEAREST_DEPTH
        behind |= close
        v = fy * down / np.where(close, 1.0, depth)
        top, bottom = np.minimum(top, v), np.maximum(bottom, v)
    return np.where(behind, np.inf, bottom - top)


def interval(seen: np.ndarray, pose: np.ndarray, direction: np.ndarray, size: np.ndarray, fy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest distance, over TURNS turns, at which a box of the prior's size has the observed height; nan if none has."""
    lows, highs = np.full(len(seen), np.nan), np.full(len(seen), np.nan)
    for k in range(TURNS):
        yaw = k * np.pi / TURNS
        near, away = np.full(len(seen), NEAR), np.full(len(seen), FAR)
        possible = (seen > 0) & ~(heights(near, pose, direction, size, yaw, fy) < seen) & ~(heights(away, pose, direction, size, yaw, fy) > seen)
        for _ in range(STEPS):
            middle = (near + away) / 2
            taller = heights(middle, pose, direction, size, yaw, fy) > seen
            near, away = np.where(taller, middle, near), np.where(taller, away, middle)
        found = np.where(possible, (near + away) / 2, np.nan)
        lows, highs = np.fmin(lows, found), np.fmax(highs, found)
    return lows, highs


def ranged(observations: DataFrame, priors: DataFrame) -> DataFrame:
    """The kept detections with lo and hi, the union of the distance intervals of all upright priors of their category. ``priors``: category, upright, sx, sy, sz."""
    sizes = priors.filter("upright").groupBy("category").agg(F.collect_list(F.array("sx", "sy", "sz")).alias("sizes"))
    kept = observations.filter("fate = 'kept'").join(sizes, "category", "left")
    columns = ["scan", "keyframe", "position", "detection", "time_us", "label", "category", "score", "x1", "y1", "y2", "fy", *POSE, *RAY]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count = np.array([0 if x is None else len(x) for x in b["sizes"]])
            each = np.repeat(np.arange(len(b)), count)
            lo, hi = np.full(len(b), np.nan), np.full(len(b), np.nan)
            if len(each):
                numbers = b[["y1", "y2", "fy", *POSE, *RAY]].to_numpy(float)[each]
                size = np.array([s for x in b["sizes"] if x is not None for s in x], float).reshape(-1, 3)
                low, high = interval(numbers[:, 1] - numbers[:, 0], numbers[:, 3:12].reshape(-1, 3, 3), numbers[:, 15:18], size, numbers[:, 2])
                np.fmin.at(lo, each, low)
                np.fmax.at(hi, each, high)
            out = b[[c for c in columns if c not in ("fy", *POSE)]].copy()
            for name, values in (("lo", lo), ("hi", hi)):
                out[name] = pd.Series(values, b.index).astype(object).where(~np.isnan(values), None)
            yield out

    given = kept.select(*columns, "sizes")
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    return given.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in columns if c not in ("fy", *POSE)), "lo double, hi double"]))


def agree(a: tuple, b: tuple) -> bool:
    """Whether two distance intervals overlap once widened by the tolerance; a missing one agrees with all."""
    if np.isnan(a[0]) or np.isnan(b[0]):
        return True
    return a[0] * (1 - RANGE_TOLERANCE) <= b[1] * (1 + RANGE_TOLERANCE) and b[0] * (1 - RANGE_TOLERANCE) <= a[1] * (1 + RANGE_TOLERANCE)


def fits(lo: np.ndarray, hi: np.ndarray, along: np.ndarray) -> np.ndarray:
    """Whether distances lie in their intervals, widened by the tolerance."""
    return np.isnan(lo) | ((along >= lo * (1 - RANGE_TOLERANCE)) & (along <= hi * (1 + RANGE_TOLERANCE)))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def merged(rays: pd.DataFrame) -> pd.DataFrame:
    """The sightings of one scan, position and category: each ray, in order, joins the first sighting that points its way at an agreeing distance."""
    rays = rays.sort_values(["keyframe", "x1", "y1", "label", "detection"], kind="stable")
    numbers = rays[[*RAY, "lo", "hi"]].to_numpy(float)
    sightings: list[list[int]] = []
    means: list[tuple[np.ndarray, tuple]] = []
    closest = np.cos(np.radians(SAME_DEG))
    for n, row in enumerate(numbers):
        hit = next((i for i, (d, span) in enumerate(means) if d @ row[3:6] >= closest and agree(span, (row[6], row[7]))), None)
        if hit is None:
            hit = len(sightings)
            sightings.append([])
            means.append((row[3:6], (row[6], row[7])))
        sightings[hit].append(n)
        of = numbers[sightings[hit]]
        known = of[~np.isnan(of[:, 6])]
        means[hit] = (unit(of[:, 3:6].sum(0)), tuple(np.median(known[:, 6:8], axis=0)) if len(known) else (np.nan, np.nan))
    first = rays.iloc[[s[0] for s in sightings]]
    out = first[["scan", "position", "category", "label", "keyframe", "x1", "y1"]].copy()
    origins = np.array([numbers[s, :3].mean(0) for s in sightings])
    for j, c in enumerate("xyz"):
        out[f"o{c}"], out[f"d{c}"] = origins[:, j], [m[0][j] for m in means]
    out["lo"], out["hi"] = [m[1][0] for m in means], [m[1][1] for m in means]
    of = [rays.iloc[s] for s in sightings]
    out["members"] = [[{"keyframe": int(k), "detection": int(d)} for k, d in zip(x["keyframe"], x["detection"], strict=True)] for x in of]
    out["score"], out["time_us"] = [x["score"].max() for x in of], [x["time_us"].max() for x in of]
    out["first_keyframe"], out["first_x1"] = [x["keyframe"].min() for x in of], [x["x1"].min() for x in of]
    return out


SIGHTING = "label string, keyframe bigint, x1 double, y1 double, ox double, dx double, oy double, dy double, oz double, dz double, lo double, hi double, members array<struct<keyframe: bigint, detection: bigint>>, score double, time_us bigint, first_keyframe bigint, first_x1 double"


def sightings(rays: DataFrame) -> DataFrame:
    """The sightings of every scan, standing position and category."""
    keys = rays.schema
    kinds = ", ".join(f"{k} {keys[k].dataType.simpleString()}" for k in ("scan", "position", "category"))
    return rays.groupBy("scan", "position", "category").applyInPandas(merged, f"{kinds}, {SIGHTING}")


class Rays:
    """The sightings of one scan and category as arrays."""

    def __init__(self, table: pd.DataFrame) -> None:
        numbers = table[[*RAY, "lo", "hi"]].to_numpy(float)
        self.origin, self.direction, self.lo, self.hi = numbers[:, :3], numbers[:, 3:6], numbers[:, 6], numbers[:, 7]
        self.position = table["position"].to_numpy()

    def point(self, of: list[int]) -> np.ndarray | None:
        """The least-squares point of rays."""
        d, o = self.direction[of], self.origin[of]
        across = np.eye(3) - d[:, :, None] * d[:, None]
        matrix = across.sum(0)
        return None if abs(np.linalg.det(matrix)) < SINGULAR else np.linalg.solve(matrix, np.einsum("nij,nj->i", across, o))

    def off(self, of: list[int], point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far a point is off each ray, and along it."""
        away = point - self.origin[of]
        along = np.einsum("nx,nx->n", away, self.direction[of])
        return np.linalg.norm(away - along[:, None] * self.direction[of], axis=1), along

    def costs(self, track: list[int], centre: np.ndarray | None, here: list[int]) -> np.ndarray:
        """The cost of joining each sighting of a position to a track; infinite where a test fails."""
        none = np.full(len(here), np.inf)
        if np.isin(self.position[track], self.position[here[0]]).any():
            return none
        if centre is not None:
            gap, along = self.off(here, centre)
            fine = (along > 0) & (along <= FAR) & fits(self.lo[here], self.hi[here], along) & (gap <= GAP)
            return np.where(fine, gap, none)
        a = track[0]
        b = self.direction[here] @ self.direction[a]
        between = self.origin[a] - self.origin[here]
        d, e = between @ self.direction[a], np.einsum("nx,nx->n", between, self.direction[here])
        across = np.maximum(1 - b * b, 1e-12)
        s, r = (b * e - d) / across, (e - b * d) / across
        gap = np.linalg.norm(self.origin[a] + s[:, None] * self.direction[a] - self.origin[here] - r[:, None] * self.direction[here], axis=1)
        angle = np.degrees(np.arccos(np.clip(b, -1, 1)))
        fine = (1 - b * b >= 1e-12) & (s > 0) & (r > 0) & (s <= FAR) & (r <= FAR) & (angle >= PARALLAX_DEG) & (angle <= 180 - PARALLAX_DEG) & (gap <= GAP)
        return np.where(fine & fits(self.lo[a], self.hi[a], s) & fits(self.lo[here], self.hi[here], r), gap, none)


class Tracks:
    """Tracks over the positions of one scan and category: lists of sightings, fitted centres, possible duplicates, sightings joined along their rays."""

    def __init__(self, rays: Rays) -> None:
        self.rays = rays
        self.sightings: list[list[int]] = []
        self.centre: list[np.ndarray | None] = []
        self.twins: list[set[int]] = []
        self.attached: list[list[int]] = []

    def start(self, sighting: int) -> int:
        self.sightings.append([sighting])
        self.centre.append(None)
        self.twins.append(set())
        self.attached.append([])
        return len(self.sightings) - 1

    def pair(self, a: int, b: int) -> None:
        self.twins[a].add(b)
        self.twins[b].add(a)

    def places(self, track: int) -> int:
        return len(set(self.rays.position[self.sightings[track]].tolist()))

    def step(self, here: list[int]) -> None:
        """Join the sightings of the next position."""
        n = len(self.sightings)
        cost = np.array([self.rays.costs(self.sightings[i], self.centre[i], here) for i in range(n)]).reshape(n, len(here))
        owner: dict[int, int] = {}
        best_row, best_column = (cost.min(axis=1, initial=np.inf), cost.min(axis=0, initial=np.inf))
        for i, j in assigned(cost):
            bar = max(cost[i, j], LEAST_COST) * RIVAL
            if (cost[i] <= bar).sum() + (cost[:, j] <= bar).sum() == 2:  # itself, twice: no rival
                owner[j] = i
        for j, i in owner.items():
            self.sightings[i].append(here[j])
        for j in range(len(here)):
            if j not in owner:
                owner[j] = self.start(here[j])
        for i, j in zip(*np.nonzero(np.isfinite(cost)), strict=True):
            if owner[j] != i and cost[i, j] <= max(min(best_row[i], best_column[j]), LEAST_COST) * RIVAL:
                self.pair(int(i), owner[j])
        for track in range(len(self.sightings)):
            self.refit(track)

    def refit(self, track: int) -> None:
        """Fit a track's point; the ray farthest from it beyond the gap becomes a track of its own, until none is."""
        while True:
            of = self.sightings[track]
            self.centre[track] = self.rays.point(of) if self.places(track) > 1 else None
            if self.centre[track] is None:
                return
            off, _ = self.rays.off(of, self.centre[track])
            worst = int(np.argmax(off))
            if off[worst] <= GAP:
                return
            self.pair(track, self.start(of.pop(worst)))

    def attach(self, reach: float) -> list[int]:
        """Join tracks of one position to a fitted one near their rays. The tracks that stay."""
        placed = [i for i in range(len(self.sightings)) if self.centre[i] is not None and self.places(i) > 1]
        gone: set[int] = set()
        for one in range(len(self.sightings)):
            of = self.sightings[one]
            if self.places(one) != 1:
                continue
            near = []
            for other in placed:
                off, along = self.rays.off(of, self.centre[other])
                if (along > 0).all() and off.max() <= reach:
                    near.append((off.max(), other, along.min()))
            if not near or self.twins[one]:
                continue
            near.sort(key=lambda x: x[:2])
            bar = max(near[0][0], LEAST_OFF) * RIVAL
            rivals = [x for x in near if x[0] <= bar]
            if len(rivals) > 1:
                for _, other, _ in rivals:
                    self.pair(one, other)
            elif not fits(self.rays.lo[of], self.rays.hi[of], np.full(len(of), near[0][2])).all():
                self.pair(one, near[0][1])
            else:
                self.attached[near[0][1]] += of
                gone.add(one)
        return [i for i in range(len(self.sightings)) if i not in gone]

    def place(self, track: int) -> tuple[np.ndarray | None, bool]:
        """A track's centre, and whether it comes from a size prior."""
        first = self.sightings[track][0]
        if self.centre[track] is not None or self.places(track) > 1 or np.isnan(self.rays.lo[first]):
            return self.centre[track], False
        return self.rays.origin[first] + (self.rays.lo[first] + self.rays.hi[first]) / 2 * self.rays.direction[first], True


def tracked(table: pd.DataFrame) -> pd.DataFrame:
    """The tracks of one scan and category."""
    table = table.sort_values(["position", "keyframe", "x1", "y1", "label"], kind="stable").reset_index(drop=True)
    rays = Rays(table)
    tracks = Tracks(rays)
    for position in sorted(set(rays.position.tolist())):
        tracks.step(np.flatnonzero(rays.position == position).tolist())
    rows = []
    for i in tracks.attach(float(table["reach"].iloc[0])):
        centre, from_size = tracks.place(i)
        of = table.iloc[tracks.sightings[i] + tracks.attached[i]]
        places = of["position"].nunique()
        members = sorted(((m["keyframe"], m["detection"]) for x in of["members"] for m in x))
        rows.append((
            table["scan"].iloc[0], table["category"].iloc[0], i, table["label"].iloc[tracks.sightings[i][0]], *((None,) * 3 if centre is None else map(float, centre)), from_size, len(members), places,
            len(tracks.attached[i]), sorted(tracks.twins[i]), float(of["score"].max()), int(of["time_us"].max()), int(of["first_keyframe"].min()), float(of["first_x1"].min()), [{"keyframe": int(k), "detection": int(d)} for k, d in members],
        ))
    return pd.DataFrame(rows, columns=["scan", "category", "track", "label", "cx", "cy", "cz", "from_size", "keyframes", "positions", "joined_by_ray", "twins", "score", "time_us", "first_keyframe", "first_x1", "members"])


TRACK = "track bigint, label string, cx double, cy double, cz double, from_size boolean, keyframes bigint, positions bigint, joined_by_ray bigint, twins array<bigint>, score double, time_us bigint, first_keyframe bigint, first_x1 double, members array<struct<keyframe: bigint, detection: bigint>>"


def localized(detections: DataFrame, priors: DataFrame) -> DataFrame:
    """The objects of every scan: scan, object_id, category, label, centre (null if not estimated), size_m (of a category with one prior), status, may_duplicate and what was seen of each.

    ``detections`` as for ``observed``; ``priors``: category, upright, sx, sy, sz.
    """
    seen = sightings(ranged(observed(detections), priors))
    known = priors.groupBy("category").agg((F.max(F.greatest("sx", "sy", "sz")) / 2 + ATTACH_MARGIN).alias("reach"), F.when(F.count(F.lit(1)) == 1, F.first(F.array("sx", "sy", "sz"))).alias("size_m"))
    reached = seen.join(known.select("category", "reach"), "category", "left").fillna(ATTACH_REACH, "reach")
    kinds = ", ".join(f"{k} {seen.schema[k].dataType.simpleString()}" for k in ("scan", "category"))
    tracks = reached.groupBy("scan", "category").applyInPandas(tracked, f"{kinds}, {TRACK}")
    spot = [F.coalesce(F.round(f"c{s}", 4), F.lit(0.0)) for s in "xyz"]
    order = Window.partitionBy("scan").orderBy("category", F.col("cx").isNull().cast("int"), *spot, "first_keyframe", "first_x1", "track")
    numbered = tracks.withColumn("object_id", F.format_string("obj_%03d", F.row_number().over(order)))
    names = Window.partitionBy("scan", "category")
    twins = F.array_sort(F.transform(F.filter(F.collect_list(F.struct("track", "object_id")).over(names), lambda x: F.array_contains(F.col("twins"), x["track"])), lambda x: x["object_id"]))
    named = numbered.withColumn("may_duplicate", twins)
    status = F.when(F.size("may_duplicate") > 0, "possible_duplicate").when(F.col("positions") >= 2, "multi_position").otherwise("single_position")
    return named.join(known.select("category", "size_m"), "category", "left").select("scan", "object_id", "category", "label", *[F.round(f"c{s}", 4).alias(f"c{s}") for s in "xyz"], "from_size", "size_m", status.alias("status"), "may_duplicate", "keyframes", "positions", "joined_by_ray", "score", "time_us", "members")


def left_out(detections: DataFrame) -> DataFrame:
    """(scan, fate, n): the detections of each scan by fate."""
    return observed(detections).groupBy("scan", "fate").agg(F.count(F.lit(1)).alias("n"))


#: Standing positions of the derived scans, on a ring: their number and radius, and the keyframes at each with their turns in degrees.
PLACES, RADIUS, TURNED = 6, 4.5, (-12.0, 0.0, 12.0)


def scan_priors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("table", True, 1.2, 0.8, 0.75), ("chair", True, 0.5, 0.5, 0.9), ("chair", True, 0.45, 0.45, 0.5), ("box", True, 0.4, 0.3, 0.3)], "category string, upright boolean, sx double, sy double, sz double")


def scan_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a camera on a ring around the vectors' objects would detect: each object from each keyframe that has it before the camera.

    A scan is a block of 200 vectors of a label. The pose is the tracker's; the box is the projection of the category's usual size, and the score is taken from the vector.
    """
    e = lambda i: F.element_at("embedding", i).cast("double")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("table", "chair", "box", "lamp", None)]), (F.col("vec_id") % 5 + 1).cast("int"))
    tall = F.when(kind == "table", 0.75).when(kind == "chair", 0.9).when(kind == "box", 0.3).otherwise(0.6)
    things = read(spark, sf_dir, "embeddings").select((F.col("label") * 1_000_000 + F.floor(F.col("vec_id") / 200)).cast("bigint").alias("scan"), F.col("vec_id").alias("detection"), kind.alias("category"), (12 * e(1)).alias("sx"), (12 * e(2)).alias("sy"), (0.4 + 2 * F.abs(e(3))).alias("sz"), tall.alias("tall"), (0.35 + F.abs(e(4))).alias("score"))
    places = F.explode(F.array(*[F.struct(F.lit(p).cast("bigint").alias("position"), F.lit(p * len(TURNED) + k).cast("bigint").alias("keyframe"), F.lit(float(2 * np.pi * p / PLACES)).alias("angle"), F.lit(float(np.radians(t))).alias("aside")) for p in range(PLACES) for k, t in enumerate(TURNED)]))
    shot = things.withColumn("k", places).select("*", "k.*").drop("k")
    # the camera looks at the middle, turned aside: yaw about the tracker's y axis
    px, pz = RADIUS * F.sin("angle"), RADIUS * F.cos("angle")
    yaw = F.col("angle") + np.pi + F.col("aside")
    right, ahead = (F.col("sx") - px) * F.cos(yaw) - (F.col("sy") - pz) * F.sin(yaw), (F.col("sx") - px) * F.sin(yaw) + (F.col("sy") - pz) * F.cos(yaw)
    up = F.col("sz") - 1.5
    focal, width, height = 500.0, 1000.0, 800.0
    based = shot.select("*", px.alias("px"), F.lit(1.5).alias("py"), pz.alias("pz"), F.lit(0.0).alias("qx"), F.sin(yaw / 2).alias("qy"), F.lit(0.0).alias("qz"), F.cos(yaw / 2).alias("qw"), right.alias("right"), ahead.alias("ahead"), up.alias("up")).filter("ahead > 0.5")
    u, v, half = 500 + focal * F.col("right") / F.col("ahead"), 400 - focal * F.col("up") / F.col("ahead"), focal * F.col("tall") / F.col("ahead") / 2
    boxed = based.select("*", *[(c + 0.5).alias(n) for n, c in (("x1", u - half), ("x2", u + half), ("y1", v - half), ("y2", v + half))])
    inside = boxed.filter((F.col("x2") > 0) & (F.col("x1") < width) & (F.col("y2") > 0) & (F.col("y1") < height))
    return inside.select("scan", "keyframe", "position", "detection", (F.col("keyframe") * 1_000_000).alias("time_us"), F.coalesce("category", F.lit("thing")).alias("label"), "category", "score", "x1", "y1", "x2", "y2", F.lit(width).alias("width"), F.lit(height).alias("height"), *[F.lit(focal).alias(f"f{s}") for s in "xy"], F.lit(500.0).alias("cx"), F.lit(400.0).alias("cy"), "px", "py", "pz", "qx", "qy", "qz", "qw")


def q_localized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return localized(scan_detections(spark, sf_dir), scan_priors(spark)).drop("members")


def q_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return left_out(scan_detections(spark, sf_dir))


QUERIES = {"localized_objects": q_localized, "localization_fates": q_left_out}
_DETECTED = """
    things AS (
        SELECT label::BIGINT * 1000000 + vec_id // 200 AS scan, vec_id % 5 AS kind, 12 * embedding[1]::DOUBLE AS sx, 12 * embedding[2]::DOUBLE AS sy, 0.4::DOUBLE + 2 * abs(embedding[3]::DOUBLE) AS sz, 0.35::DOUBLE + abs(embedding[4]::DOUBLE) AS score,
               CASE vec_id % 5 WHEN 0 THEN 0.75 WHEN 1 THEN 0.9 WHEN 2 THEN 0.3 ELSE 0.6 END::DOUBLE AS tall
        FROM embeddings
    ), shots AS (
        SELECT *, 4.5 * sin(2 * pi() * p / 6) AS px, 4.5 * cos(2 * pi() * p / 6) AS pz, 2 * pi() * p / 6 + pi() + radians(t) AS yaw FROM things, range(6) r(p), (SELECT unnest([-12, 0, 12]) AS t)
    ), seen AS (
        SELECT *, (sx - px) * cos(yaw) - (sy - pz) * sin(yaw) AS rightwards, (sx - px) * sin(yaw) + (sy - pz) * cos(yaw) AS ahead FROM shots
    ), boxed AS (
        SELECT *, 500.5 + 500 * rightwards / ahead AS u, 400.5 - 500 * (sz - 1.5) / ahead AS v, 250 * tall / ahead AS half FROM seen WHERE ahead > 0.5
    )
"""
SQL = {
    "localization_fates": f"""
        WITH {_DETECTED}
        SELECT scan, CASE WHEN kind = 4 THEN 'unmapped_label' WHEN score < 0.3 THEN 'below_min_score' WHEN u - half <= 4 OR v - half <= 4 OR u + half >= 996 OR v + half >= 796 THEN 'cut_by_the_edge' ELSE 'kept' END AS fate, count(*) AS n
        FROM boxed WHERE u + half > 0 AND u - half < 1000 AND v + half > 0 AND v - half < 800 GROUP BY ALL
    """
}
