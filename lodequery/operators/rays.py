"""Sightings as rays: their least-squares point, links between them, distance from a size prior, and boxes around points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import AXES, OBJECTS, objects, read

#: Largest gap of two rays, longest range, smallest parallax in degrees, tolerance of a range, singular determinant.
GAP, FAR, PARALLAX, RANGE_TOLERANCE, SINGULAR = 0.25, 8.0, 4.0, 0.15, 1e-9
#: Fixed values of the size prior: nearest distance, bisection steps, turns of the box, nearest depth before the camera.
NEAR, STEPS, TURNS, NEAREST_DEPTH = 0.3, 40, 6, 0.05
#: Fixed values of the box fit: closest distance that counts, smallest side, coarse and fine steps in degrees.
CLOSE, LEAST_SIDE, COARSE, FINE = 0.01, 0.02, 10, 9
CELL = 1.0


def dot(left: str, right: str) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"{left}{s}") * F.col(f"{right}{s}") for s in AXES])


def determinant(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def meeting_points(rays: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, px, py, pz): the point closest to all rays of a key in the least-squares sense; null for parallel rays.

    ``rays`` has origins ox, oy, oz and unit directions dx, dy, dz. Nine sums for each key, then Cramer's rule.
    """
    m = {i + j: (1.0 if i == j else 0.0) - F.col(f"d{i}") * F.col(f"d{j}") for i in AXES for j in AXES if i <= j}
    at = lambda i, j: m[min(i, j) + max(i, j)]
    right = {i: sum((at(i, j) * F.col(f"o{j}") for j in "yz"), at(i, "x") * F.col("ox")) for i in AXES}
    sums = rays.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"_{k}") for k, c in m.items()], *[F.sum(c).alias(f"_b{i}") for i, c in right.items()])
    a = [[F.col(f"_{min(i, j)}{max(i, j)}") for j in AXES] for i in AXES]
    b = [F.col(f"_b{i}") for i in AXES]
    whole = sums.withColumn("_det", determinant(a))
    point = lambda k: determinant([[b[r] if c == k else a[r][c] for c in range(3)] for r in range(3)])
    return whole.select(*keys, "n", *[F.when(F.abs("_det") >= SINGULAR, point(k) / F.col("_det")).alias(f"p{s}") for k, s in enumerate(AXES)])


def fits(low: Column, high: Column, value: Column) -> Column:
    """Whether a distance lies in an interval widened by the tolerance; an open end always fits."""
    return (low.isNull() | (value >= low * (1 - RANGE_TOLERANCE))) & (high.isNull() | (value <= high * (1 + RANGE_TOLERANCE)))


def links(rays: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a_id, b_id, gap_m) of the pairs of rays from different positions that can be one object.

    Rays of a key and category join when both pass within GAP of each other before the origins and in range, with enough parallax and
    at distances that fit their size priors (lo, hi). Two such rays share a cell of the grid of the points along a ray,
    so only rays of a common cell or its neighbours are compared: each ray is sampled every CELL / 2 up to FAR.
    """
    along = F.explode(F.transform(F.sequence(F.lit(0), F.lit(int(2 * FAR / CELL))), lambda i: i * (CELL / 2)))
    reach = [F.floor((F.col(f"o{s}") + F.col("_t") * F.col(f"d{s}")) / CELL) for s in AXES]
    cells = rays.withColumn("_t", along).select("*", F.struct(*[c.alias(s) for c, s in zip(reach, AXES)]).alias("_c")).drop("_t").distinct()
    offsets = F.array(*[F.struct(*[F.lit(v).alias(s) for v, s in zip((i, j, k), AXES)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    near = cells.withColumn("_o", F.explode(offsets)).withColumn("_c", F.struct(*[(F.col(f"_c.{s}") + F.col(f"_o.{s}")).alias(s) for s in AXES])).drop("_o").distinct()
    fields = [c for c in rays.columns if c not in (*keys, "category")]
    left = cells.select(*keys, "category", "_c", *[F.col(c).alias(f"a_{c}") for c in fields])
    right = near.select(*keys, "category", "_c", *[F.col(c).alias(f"b_{c}") for c in fields])
    pairs = left.join(right, [*keys, "category", "_c"]).filter("a_ray_id < b_ray_id and a_position <> b_position").drop("_c").dropDuplicates([*keys, "a_ray_id", "b_ray_id"])
    w = [F.col(f"a_o{s}") - F.col(f"b_o{s}") for s in AXES]
    along_w = lambda side: sum((F.col(f"{side}_d{s}") * c for s, c in zip("yz", w[1:])), F.col(f"{side}_dx") * w[0])
    measured = pairs.select("*", dot("a_d", "b_d").alias("_b"), along_w("a").alias("_d"), along_w("b").alias("_e")).withColumn("_n", 1 - F.col("_b") * F.col("_b"))
    timed = measured.filter("_n >= 1e-12").select("*", ((F.col("_b") * F.col("_e") - F.col("_d")) / F.col("_n")).alias("_s"), ((F.col("_e") - F.col("_b") * F.col("_d")) / F.col("_n")).alias("_u"))
    apart = [F.col(f"a_o{s}") + F.col("_s") * F.col(f"a_d{s}") - F.col(f"b_o{s}") - F.col("_u") * F.col(f"b_d{s}") for s in AXES]
    gap = F.sqrt(sum((c * c for c in apart[1:]), apart[0] * apart[0]))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_b")))))
    held = (F.col("_s") > 0) & (F.col("_u") > 0) & (F.greatest("_s", "_u") <= FAR) & angle.between(PARALLAX, 180 - PARALLAX) & fits(F.col("a_lo"), F.col("a_hi"), F.col("_s")) & fits(F.col("b_lo"), F.col("b_hi"), F.col("_u"))
    return timed.filter(held).select(*keys, F.col("a_ray_id").alias("a_id"), F.col("b_ray_id").alias("b_id"), gap.alias("gap_m")).filter(F.col("gap_m") <= GAP)


def heights(r: np.ndarray, direction: np.ndarray, size: np.ndarray, yaw: float, focal: np.ndarray) -> np.ndarray:
    """Projected heights in pixels of upright boxes at distances r along their directions (camera: x right, y down, z ahead)."""
    c, s = np.cos(yaw), np.sin(yaw)
    top, bottom, behind = np.full(len(r), np.inf), np.full(len(r), -np.inf), np.zeros(len(r), bool)
    for corner in range(8):
        x, y, z = ((0.5 if corner >> k & 1 else -0.5) * size[:, k] for k in range(3))
        right, ahead, up = c * x - s * y, s * x + c * y, z
        depth = r * direction[:, 2] + ahead
        behind |= depth < NEAREST_DEPTH
        v = focal * (r * direction[:, 1] - up) / np.where(depth < NEAREST_DEPTH, 1.0, depth)
        top, bottom = np.minimum(top, v), np.maximum(bottom, v)
    return np.where(behind, np.inf, bottom - top)


def distance_interval(seen: np.ndarray, direction: np.ndarray, size: np.ndarray, focal: np.ndarray, far: float = FAR) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) over TURNS turns of the distance at which a box of the prior's size has the observed height; nan where none has."""
    lows, highs = np.full(len(seen), np.nan), np.full(len(seen), np.nan)
    with np.errstate(invalid="ignore"):
        for k in range(TURNS):
            yaw = k * np.pi / TURNS
            near, away = np.full(len(seen), NEAR), np.full(len(seen), far)
            possible = (seen > 0) & ~(heights(near, direction, size, yaw, focal) < seen) & ~(heights(away, direction, size, yaw, focal) > seen)
            for _ in range(STEPS):
                middle = (near + away) / 2
                taller = heights(middle, direction, size, yaw, focal) > seen
                near, away = np.where(taller, middle, near), np.where(taller, away, middle)
            found = np.where(possible, (near + away) / 2, np.nan)
            lows, highs = np.fmin(lows, found), np.fmax(highs, found)
    return lows, highs


def ranged(df: DataFrame) -> DataFrame:
    """Adds lo and hi, the distances that explain height_px for the prior's size (sx, sy, sz); null where none does."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part = lambda *names: b[list(names)].to_numpy(float)
            lo, hi = distance_interval(part("height_px")[:, 0], part("dx", "dy", "dz"), part("sx", "sy", "sz"), part("focal_px")[:, 0])
            yield b.assign(lo=pd.Series(lo, b.index).astype(object).where(~np.isnan(lo), None), hi=pd.Series(hi, b.index).astype(object).where(~np.isnan(hi), None))

    return df.mapInPandas(step, df.select("*", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")).schema)


def trimmed(values: np.ndarray, share: float) -> tuple[float, float]:
    """The values at a share from either end, the nearer index, halves away from zero."""
    ordered, last = np.sort(values), len(values) - 1
    at = lambda f: ordered[max(0, min(last, int(np.floor(f * last + 0.5))))]
    return at(share), at(1 - share)


def turned_box(x: np.ndarray, z: np.ndarray, trim: float = 0.03) -> tuple[int, float, float]:
    """(turn in degrees, length, width) of the footprint whose edges the points hug most closely; ties to the smaller turn."""

    def closeness(degrees: int) -> tuple[float, float, float]:
        c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
        u, w = x * c - z * s, x * s + z * c
        (ul, uh), (wl, wh) = trimmed(u, trim), trimmed(w, trim)
        edge = np.minimum(np.minimum(abs(u - ul), abs(uh - u)), np.minimum(abs(w - wl), abs(wh - w)))
        return float((1 / np.maximum(edge, CLOSE)).sum()), uh - ul, wh - wl

    def best(turns: list[int]) -> int:
        scores = {d: round(closeness(d)[0], 9) for d in turns}
        return min(d for d in turns if scores[d] == max(scores.values()))

    coarse = best(list(range(0, 90, COARSE)))
    turn = best(sorted({(coarse + d) % 90 for d in range(-FINE, FINE + 1)}))
    _, length, width = closeness(turn)
    return turn, max(length, LEAST_SIDE), max(width, LEAST_SIDE)


def fitted_boxes(points: DataFrame, keys: list[str], most: int = 4096) -> DataFrame:
    """(keys, n, turn, length, width): the upright box around each object's points.

    An object of more than ``most`` points is thinned first, to one point for each cell of the smallest grid of 1, 2, 4... cm
    that covers it in no more than ``most`` cells; so a task never holds more points of an object than that.
    """
    bounds = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[(F.max(s) - F.min(s)).alias(f"_{s}") for s in "xz"])
    sides = F.greatest("_x", "_z")
    voxel = F.greatest(F.lit(0.01), 0.01 * F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(sides / (np.sqrt(most) - 2) / 0.01, F.lit(1.0))))))
    sized = points.join(bounds.select(*keys, "n", F.when(F.col("n") > most, voxel).alias("_v")), keys)
    few = sized.filter("_v is null").select(*keys, "n", "x", "z")
    many = sized.filter("_v is not null").groupBy(*keys, "n", F.floor(F.col("x") / F.col("_v")), F.floor(F.col("z") / F.col("_v"))).agg(F.min(F.struct("x", "z")).alias("p")).select(*keys, "n", "p.x", "p.z")

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        turn, length, width = turned_box(pdf["x"].to_numpy(), pdf["z"].to_numpy())
        return pd.DataFrame([(*key, int(pdf["n"].iloc[0]), turn, length, width)])

    types = ", ".join(f"{k} {dict(points.dtypes)[k]}" for k in keys)
    return few.unionByName(many).groupBy(*keys).applyInPandas(fit, f"{types}, n bigint, turn int, length double, width double")


def thinned(points: DataFrame, keys: list[str], voxel: float) -> DataFrame:
    """One point for each voxel of a key: the first by id."""
    cell = [F.floor(F.col(s) / voxel).alias(f"v{s}") for s in AXES]
    return points.groupBy(*keys, *cell).agg(F.min_by(F.struct("point_id", *AXES), "point_id").alias("p"), F.count(F.lit(1)).alias("n")).select(*keys, "p.*", "n")


def supports(things: DataFrame, gap: float = 0.05) -> DataFrame:
    """(scene_id, object_id, support_id): the box that an object rests on, its bottom within ``gap`` of the top and its centre over it; the highest top, then the smaller id."""
    box = things.filter(F.col("cx").isNotNull()).select("scene_id", "object_id", "cx", "cy", *[f"{s}_{e}" for s in AXES for e in ("min", "max")])
    below = box.select("scene_id", *[F.col(c).alias(f"s_{c}") for c in box.columns if c != "scene_id"])
    level = F.floor(F.col("z_min") / gap)
    left = box.withColumn("_l", F.explode(F.array(level - 1, level, level + 1)))
    over = (F.abs(F.col("z_min") - F.col("s_z_max")) <= gap) & F.col("cx").between(F.col("s_x_min"), F.col("s_x_max")) & F.col("cy").between(F.col("s_y_min"), F.col("s_y_max"))
    joined = left.join(below.withColumn("_l", F.floor(F.col("s_z_max") / gap)), ["scene_id", "_l"]).filter(over & (F.col("object_id") != F.col("s_object_id")))
    return joined.groupBy("scene_id", "object_id").agg(F.max_by("s_object_id", F.struct("s_z_max", -F.col("s_object_id"))).alias("support_id"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays to the objects of a scene from four positions, with an error that grows with the id."""
    things = objects(spark, sf_dir).filter("cx is not null").withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(3))))
    origin = {"x": F.col("position") * 1.5 - 2.0, "y": F.lit(-3.0) + F.col("position") % 2, "z": F.lit(1.5)}
    aim = things.select("scene_id", "object_id", "category", "position", "sz", *[c.alias(f"o{s}") for s, c in origin.items()], *[(F.col(f"c{s}") + (F.col("object_id") % 5) * 0.02 * (F.col("position") % 3 - 1) - origin[s]).alias(f"w{s}") for s in AXES])
    norm = F.sqrt(dot("w", "w"))
    return aim.select("scene_id", "object_id", "category", "position", (F.col("object_id") * 4 + F.col("position")).alias("ray_id"), *[f"o{s}" for s in AXES], *[(F.col(f"w{s}") / norm).alias(f"d{s}") for s in AXES], F.when(F.col("object_id") % 3 == 0, norm * 0.9).alias("lo"), F.when(F.col("object_id") % 3 == 0, norm * 1.1).alias("hi"))


def q_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meeting_points(sightings(spark, sf_dir), ["scene_id", "object_id"]).select("scene_id", "object_id", "n", *[F.round(f"p{s}", 6).alias(f"p{s}") for s in AXES])


def q_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(sightings(spark, sf_dir).drop("object_id"), ["scene_id"]).withColumn("gap_m", F.round("gap_m", 6))


def q_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    things = objects(spark, sf_dir).filter("cx is not null").select("object_id", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("dz"), "sx", "sy", "sz", F.lit(500.0).alias("focal_px"), (500 * F.col("sz") / (2 + F.abs("cz"))).alias("height_px"))
    return ranged(things).select("object_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def footprint_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of an embedding's elements two by two as points of an object."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.lit(63), F.lit(2)), lambda i: F.struct(F.element_at("embedding", i).cast("double").alias("x"), F.element_at("embedding", i + 1).cast("double").alias("z"))))
    return read(spark, sf_dir, "embeddings").select("vec_id", pair.alias("p")).select("vec_id", "p.*")


def q_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted_boxes(footprint_points(spark, sf_dir), ["vec_id"])


def q_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = objects(spark, sf_dir).filter("cx is not null").select("scene_id", F.col("object_id").alias("point_id"), *[F.col(f"c{s}").alias(s) for s in AXES])
    return thinned(points, ["scene_id"], 1.0)


def q_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supports(objects(spark, sf_dir))


QUERIES = {"ray_points": q_points, "ray_links": q_links, "size_ranges": q_ranges, "footprint_boxes": q_boxes, "voxel_thinning": q_thinned, "supports": q_supports}
_RAYS = f"""
    {OBJECTS}, v AS (
        SELECT scene_id, object_id, category, position, position * 1.5::DOUBLE - 2 AS ox, -3.0::DOUBLE + position % 2 AS oy, 1.5::DOUBLE AS oz, (object_id % 5) * 0.02::DOUBLE * (position % 3 - 1) AS err, cx, cy, cz
        FROM objects CROSS JOIN (SELECT unnest(range(0, 4)) AS position) WHERE cx IS NOT NULL
    ), w AS (SELECT *, cx + err - ox AS wx, cy + err - oy AS wy, cz + err - oz AS wz FROM v), l AS (SELECT *, sqrt(wx * wx + wy * wy + wz * wz) AS norm FROM w),
    rays AS (
        SELECT scene_id, object_id, category, position, object_id * 4 + position AS ray_id, ox, oy, oz, wx / norm AS dx, wy / norm AS dy, wz / norm AS dz,
               CASE WHEN object_id % 3 = 0 THEN norm * 0.9 END AS lo, CASE WHEN object_id % 3 = 0 THEN norm * 1.1 END AS hi
        FROM l
    )
"""
SQL = {
    "ray_points": f"""
        WITH {_RAYS}, s AS (
            SELECT scene_id, object_id, count(*) AS n, sum(1 - dx * dx) AS a, sum(-dx * dy) AS b, sum(-dx * dz) AS c, sum(1 - dy * dy) AS d, sum(-dy * dz) AS e, sum(1 - dz * dz) AS f,
                   sum((1 - dx * dx) * ox - dx * dy * oy - dx * dz * oz) AS u, sum((1 - dy * dy) * oy - dx * dy * ox - dy * dz * oz) AS v, sum((1 - dz * dz) * oz - dx * dz * ox - dy * dz * oy) AS w
            FROM rays GROUP BY ALL
        ), t AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM s)
        SELECT scene_id, object_id, n, CASE WHEN abs(det) >= {SINGULAR} THEN round((u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w)) / det, 6) END AS px,
               CASE WHEN abs(det) >= {SINGULAR} THEN round((a * (v * f - e * w) - u * (b * f - e * c) + c * (b * w - v * c)) / det, 6) END AS py,
               CASE WHEN abs(det) >= {SINGULAR} THEN round((a * (d * w - v * e) - b * (b * w - v * c) + u * (b * e - d * c)) / det, 6) END AS pz FROM t
    """,
    "ray_links": f"""
        WITH {_RAYS}, p AS (
            SELECT x.scene_id, x.ray_id AS a_id, y.ray_id AS b_id, x.dx * y.dx + x.dy * y.dy + x.dz * y.dz AS b, x.dx * (x.ox - y.ox) + x.dy * (x.oy - y.oy) + x.dz * (x.oz - y.oz) AS d,
                   y.dx * (x.ox - y.ox) + y.dy * (x.oy - y.oy) + y.dz * (x.oz - y.oz) AS e, x.lo AS xlo, x.hi AS xhi, y.lo AS ylo, y.hi AS yhi,
                   x.ox AS xox, x.oy AS xoy, x.oz AS xoz, y.ox AS yox, y.oy AS yoy, y.oz AS yoz, x.dx AS xdx, x.dy AS xdy, x.dz AS xdz, y.dx AS ydx, y.dy AS ydy, y.dz AS ydz
            FROM rays x JOIN rays y ON x.scene_id = y.scene_id AND x.category = y.category AND x.ray_id < y.ray_id AND x.position <> y.position
        ), t AS (SELECT *, (b * e - d) / (1 - b * b) AS s, (e - b * d) / (1 - b * b) AS u FROM p WHERE 1 - b * b >= 1e-12),
        g AS (SELECT *, sqrt((xox + s * xdx - yox - u * ydx) ** 2 + (xoy + s * xdy - yoy - u * ydy) ** 2 + (xoz + s * xdz - yoz - u * ydz) ** 2) AS gap FROM t)
        SELECT scene_id, a_id, b_id, round(gap, 6) AS gap_m FROM g
        WHERE s > 0 AND u > 0 AND s <= {FAR} AND u <= {FAR} AND degrees(acos(greatest(-1, least(1, b)))) BETWEEN {PARALLAX} AND {180 - PARALLAX} AND gap <= {GAP}
          AND (xlo IS NULL OR s BETWEEN xlo * {1 - RANGE_TOLERANCE} AND xhi * {1 + RANGE_TOLERANCE}) AND (ylo IS NULL OR u BETWEEN ylo * {1 - RANGE_TOLERANCE} AND yhi * {1 + RANGE_TOLERANCE})
    """,
    "voxel_thinning": f"""
        WITH {OBJECTS}, p AS (SELECT scene_id, object_id AS point_id, cx AS x, cy AS y, cz AS z FROM objects WHERE cx IS NOT NULL),
        r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY scene_id, floor(x), floor(y), floor(z)) AS n FROM p WINDOW w AS (PARTITION BY scene_id, floor(x), floor(y), floor(z) ORDER BY point_id))
        SELECT scene_id, point_id, x, y, z, n FROM r WHERE k = 1
    """,
    "supports": f"""
        WITH {OBJECTS}, j AS (
            SELECT t.scene_id, t.object_id, s.object_id AS support_id, row_number() OVER (PARTITION BY t.scene_id, t.object_id ORDER BY s.z_max DESC, s.object_id) AS k
            FROM objects t JOIN objects s ON s.scene_id = t.scene_id AND s.object_id <> t.object_id AND abs(t.z_min - s.z_max) <= 0.05 AND t.cx BETWEEN s.x_min AND s.x_max AND t.cy BETWEEN s.y_min AND s.y_max
        )
        SELECT scene_id, object_id, support_id FROM j WHERE k = 1
    """,
}
