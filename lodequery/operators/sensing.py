"""Sensing geometry as columns: distance of segments, rays through pixels, polygons, box priors, depth samples, mean directions.

Each is an expression on one row, or one aggregate with a map-side combine; small fixed tables (polygon, priors) are literals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import OBJECTS, objects

# A camera (focal lengths and centre in pixels), a floor polygon, box priors (name and sizes), the sides of a depth grid.
FOCAL, CENTRE = (500.0, 480.0), (320.0, 240.0)
FLOOR = ((-12.0, -9.0), (10.0, -11.0), (14.0, 4.0), (2.0, 1.0), (-6.0, 12.0))
PRIORS = (("small", (0.5, 0.5, 0.5)), ("flat", (2.0, 2.0, 0.4)), ("tall", (0.6, 0.6, 2.2)), ("large", (2.5, 1.5, 1.5)))
GRID, EPS = 3, 1e-12

Point = tuple[Column, Column, Column]


def minus(a: Point, b: Point) -> Point:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def segment_products(p1: Point, q1: Point, p2: Point, q2: Point) -> dict[str, Column]:
    """The scalar products that ``segment_distance`` needs; make them columns first, so that they are computed once."""
    d1, d2, r = minus(q1, p1), minus(q2, p2), minus(p1, p2)
    return {"a": dot(d1, d1), "b": dot(d1, d2), "c": dot(d1, r), "e": dot(d2, d2), "f": dot(d2, r), "rr": dot(r, r)}


def segment_distance(a: Column, b: Column, c: Column, e: Column, f: Column, rr: Column) -> Column:
    """Shortest distance of two segments, from their products: the better of the lines' own nearest points, clamped, and of each end to the other segment.

    The distance is convex in both places along the segments, so its least value over the unit square is where the lines are nearest, if
    that is inside, or else on a side of the square, where one place is an end.
    """
    at = lambda s, t: rr + s * s * a + t * t * e + 2 * (s * c - t * f - s * t * b)
    along = lambda top, low: F.when(low > EPS, unit(top / low)).otherwise(F.lit(0.0))
    ends = [at(F.lit(s), along(b * s + f, e)) for s in (0.0, 1.0)] + [at(along(b * t - c, a), F.lit(t)) for t in (0.0, 1.0)]
    span = a * e - b * b
    s, t = (b * f - c * e) / span, (a * f - b * c) / span
    inside = F.when((span > EPS) & s.between(0, 1) & t.between(0, 1), at(s, t))
    return F.sqrt(F.greatest(F.lit(0.0), F.least(*ends, inside)))


def projected(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """The pixel of a point in the camera's frame (z forward); null at or behind the camera."""
    ahead = z > 0
    return F.when(ahead, FOCAL[0] * x / z + CENTRE[0]), F.when(ahead, FOCAL[1] * y / z + CENTRE[1])


def pixel_ray(u: Column, v: Column) -> Point:
    """The unit direction through a pixel, in the camera's frame."""
    x, y = (u - CENTRE[0]) / FOCAL[0], (v - CENTRE[1]) / FOCAL[1]
    n = F.sqrt(x * x + y * y + 1)
    return x / n, y / n, 1 / n


def turned(x: Column, y: Column, yaw: Column) -> tuple[Column, Column]:
    """A horizontal vector turned about the vertical."""
    return x * F.cos(yaw) - y * F.sin(yaw), x * F.sin(yaw) + y * F.cos(yaw)


def in_polygon(x: Column, y: Column, corners: tuple[tuple[float, float], ...]) -> tuple[Column, Column]:
    """(inside, distance to the nearest edge): inside by the parity of the edges that a ray to the right crosses."""
    edges = list(zip(corners, [*corners[1:], corners[0]], strict=True))
    crossed = [((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax) for (ax, ay), (bx, by) in edges if ay != by]
    gaps = []
    for (ax, ay), (bx, by) in edges:
        t = unit(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2))
        gaps.append(F.sqrt(F.pow(x - ax - t * (bx - ax), 2) + F.pow(y - ay - t * (by - ay), 2)))
    return reduce(lambda a, b: a + b, [c.cast("int") for c in crossed]) % 2 == 1, F.least(*gaps)


def nearest_prior(sizes: Point, priors: tuple = PRIORS) -> Column:
    """(sse, name, sizes) of the prior of the least squared difference; the first of equal ones. Unknown sides do not count, and a box without any has none."""
    known = reduce(lambda a, b: a | b, [s.isNotNull() for s in sizes])
    far = lambda p: reduce(lambda a, b: a + b, [F.coalesce(F.pow(s - x, 2), F.lit(0.0)) for s, x in zip(sizes, p, strict=True)])
    rows = [F.struct(far(p).alias("sse"), F.lit(i).alias("place"), F.lit(n).alias("name"), *[F.lit(x).alias(f"p{s}") for s, x in zip("xyz", p, strict=True)]) for i, (n, p) in enumerate(priors)]
    return F.when(known, F.array_min(F.array(*rows)))


def depth_samples(df: DataFrame, keys: list[str], box: tuple[str, str, str, str], n: int = GRID) -> DataFrame:
    """(keys, row, column, u, v): the middles of an n x n grid over a pixel box (left, top, right, bottom)."""
    left, top, right, bottom = map(F.col, box)
    cell = F.explode(F.sequence(F.lit(0), F.lit(n * n - 1)))
    rows = df.withColumn("_cell", cell).withColumn("row", F.floor(F.col("_cell") / n).cast("int")).withColumn("column", (F.col("_cell") % n).cast("int"))
    return rows.select(*keys, "row", "column", F.round(left + (right - left) * (F.col("column") + 0.5) / n, 6).alias("u"), F.round(top + (bottom - top) * (F.col("row") + 0.5) / n, 6).alias("v"))


def mean_directions(df: DataFrame, keys: list[str], direction: tuple[str, ...], origin: tuple[str, ...], low: str, high: str) -> DataFrame:
    """(keys, n, mean direction of length one, mean origin, median interval ends); no direction where the mean vanishes."""
    means = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_{c}") for c in direction], *[F.round(F.avg(c), 9).alias(f"mean_{c}") for c in origin], F.round(F.median(low), 9).alias("low"), F.round(F.median(high), 9).alias("high"))
    length = F.sqrt(reduce(lambda a, b: a + b, [F.col(f"_{c}") * F.col(f"_{c}") for c in direction]))
    return means.select(*keys, "n", *[F.round(F.when(length > EPS, F.col(f"_{c}") / length), 6).alias(f"mean_{c}") for c in direction], *[f"mean_{c}" for c in origin], "low", "high")


def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = Window.partitionBy("scene_id").orderBy("object_id")
    columns = [f"{k}{s}" for k in "cs" for s in "xyz"]
    rows = objects(spark, sf_dir).select("scene_id", "object_id", *columns, *[F.lead(c).over(after).alias(f"o{c}") for c in columns])
    p1, p2 = (tuple(F.col(f"{o}c{s}") for s in "xyz") for o in ("", "o"))
    q1, q2 = (tuple(F.col(f"{o}c{s}") + sign * F.col(f"{o}s{s}") * 4 for s, sign in zip("xyz", signs)) for o, signs in (("", (1, 1, 1)), ("o", (1, -1, 1))))
    products = segment_products(p1, q1, p2, q2)
    made = rows.select("scene_id", "object_id", *[c.alias(n) for n, c in products.items()])
    return made.select("scene_id", "object_id", F.when(F.col("rr").isNotNull(), F.round(segment_distance(*map(F.col, products)), 6)).alias("distance_m"))


def q_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = projected(F.col("cx"), F.col("cy"), F.col("cz"))
    rows = objects(spark, sf_dir).select("object_id", F.col("fx").alias("yaw"), u.alias("u"), v.alias("v"))
    ray = pixel_ray(F.col("u"), F.col("v"))
    east, north = turned(ray[0], ray[2], F.col("yaw"))
    return rows.select("object_id", *[F.round(c, 6).alias(n) for n, c in (("u", F.col("u")), ("v", F.col("v")), ("east", east), ("north", north), ("down", ray[1]))])


def q_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside, gap = in_polygon(F.col("cx"), F.col("cy"), FLOOR)
    return objects(spark, sf_dir).select("object_id", inside.alias("inside"), F.when(F.col("cx").isNotNull(), F.round(gap, 6)).alias("edge_m"))


def q_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = [F.when(F.col("object_id") % (i + 3) != 0, F.col(f"s{s}")) for i, s in enumerate("xyz")]
    prior = nearest_prior(tuple(seen))
    filled = [F.round(F.coalesce(x, F.col("prior").getField(f"p{s}")), 9).alias(f"s{s}") for x, s in zip(seen, "xyz")]
    return objects(spark, sf_dir).withColumn("prior", prior).select("object_id", F.col("prior.name").alias("prior"), F.round("prior.sse", 6).alias("sse"), *filled)


def q_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth_samples(objects(spark, sf_dir), ["object_id"], ("x_min", "y_min", "x_max", "y_max"))


def q_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mean_directions(objects(spark, sf_dir), ["scene_id", "colour"], ("fx", "fy"), ("cx", "cy", "cz"), "z_min", "z_max")


QUERIES = {"segment_distances": q_segments, "pixel_rays": q_pixels, "floor_polygon": q_polygon, "nearest_priors": q_priors, "depth_samples": q_depth, "mean_directions": q_means}

_dots = lambda p, q: " + ".join(f"{p}{s} * {q}{s}" for s in "xyz")
_edges = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(FLOOR, [*FLOOR[1:], FLOOR[0]]))
_priors = ", ".join(f"({i}, '{n}', {', '.join(f'{x}::DOUBLE' for x in p)})" for i, (n, p) in enumerate(PRIORS))
_clamp = "CASE WHEN {e} > 1e-12 THEN greatest(0, least(1, ({f}) / {e})) ELSE 0 END"
SQL = {
    # the survey's order of cases: the place on the first segment, the nearest on the second, and once more the first if that was cut
    "segment_distances": f"""
        WITH {OBJECTS}, p AS (
            SELECT scene_id, object_id, {', '.join(f'lead(c{s}) OVER w AS oc{s}, lead(s{s}) OVER w AS os{s}, c{s}, s{s}' for s in 'xyz')} FROM objects WINDOW w AS (PARTITION BY scene_id ORDER BY object_id)
        ), v AS (SELECT scene_id, object_id, {', '.join(f's{s} * 4 AS d{s}, {"-" if s == "y" else ""}os{s} * 4 AS g{s}, c{s} - oc{s} AS r{s}' for s in 'xyz')} FROM p),
        m AS (SELECT *, {_dots('d', 'd')} AS a, {_dots('d', 'g')} AS b, {_dots('d', 'r')} AS c, {_dots('g', 'g')} AS e, {_dots('g', 'r')} AS f FROM v),
        s0 AS (SELECT *, CASE WHEN a * e - b * b > 1e-12 THEN greatest(0, least(1, (b * f - c * e) / (a * e - b * b))) ELSE 0 END AS s FROM m),
        t0 AS (SELECT *, (b * s + f) / e AS t FROM s0),
        st AS (SELECT *, greatest(0, least(1, t)) AS tt, CASE WHEN t < 0 THEN greatest(0, least(1, -c / a)) WHEN t > 1 THEN greatest(0, least(1, (b - c) / a)) ELSE s END AS ss FROM t0)
        SELECT scene_id, object_id, CASE WHEN rx IS NOT NULL THEN round(sqrt({' + '.join(f'pow(r{s} + ss * d{s} - tt * g{s}, 2)' for s in 'xyz')}), 6) END AS distance_m FROM st
    """,
    "pixel_rays": f"""
        WITH {OBJECTS}, p AS (SELECT object_id, fx AS yaw, CASE WHEN cz > 0 THEN 500.0::DOUBLE * cx / cz + 320 END AS u, CASE WHEN cz > 0 THEN 480.0::DOUBLE * cy / cz + 240 END AS v FROM objects),
        d AS (SELECT *, (u - 320) / 500.0::DOUBLE AS x, (v - 240) / 480.0::DOUBLE AS y FROM p), n AS (SELECT *, sqrt(x * x + y * y + 1) AS n FROM d)
        SELECT object_id, round(u, 6) AS u, round(v, 6) AS v, round((x / n) * cos(yaw) - (1 / n) * sin(yaw), 6) AS east, round((x / n) * sin(yaw) + (1 / n) * cos(yaw), 6) AS north, round(y / n, 6) AS down FROM n
    """,
    "floor_polygon": f"""
        WITH {OBJECTS}, edges(ax, ay, bx, b_y) AS (VALUES {_edges}), t AS (
            SELECT object_id, cx, cy, ax, ay, bx, b_y, (ay > cy) <> (b_y > cy) AND cx < (bx - ax) * (cy - ay) / (b_y - ay) + ax AS crossed,
                   greatest(0, least(1, ((cx - ax) * (bx - ax) + (cy - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)))) AS k FROM objects, edges
        ) SELECT object_id, CASE WHEN any_value(cx) IS NOT NULL THEN count(*) FILTER (crossed) % 2 = 1 END AS inside, round(min(sqrt(pow(cx - ax - k * (bx - ax), 2) + pow(cy - ay - k * (b_y - ay), 2))) FILTER (cx IS NOT NULL), 6) AS edge_m FROM t GROUP BY object_id
    """,
    "nearest_priors": f"""
        WITH {OBJECTS}, seen AS (SELECT object_id, CASE WHEN object_id % 3 <> 0 THEN sx END AS x, CASE WHEN object_id % 4 <> 0 THEN sy END AS y, CASE WHEN object_id % 5 <> 0 THEN sz END AS z FROM objects),
        priors(place, name, px, py, pz) AS (VALUES {_priors}), met AS (
            SELECT *, coalesce(pow(x - px, 2), 0) + coalesce(pow(y - py, 2), 0) + coalesce(pow(z - pz, 2), 0) AS sse FROM seen, priors QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY sse, place) = 1
        ) SELECT object_id, CASE WHEN coalesce(x, y, z) IS NOT NULL THEN name END AS prior, CASE WHEN coalesce(x, y, z) IS NOT NULL THEN round(sse, 6) END AS sse,
                 {', '.join(f'round(coalesce({s}, CASE WHEN coalesce(x, y, z) IS NOT NULL THEN p{s} END), 9) AS s{s}' for s in 'xyz')} FROM met
    """,
    "depth_samples": f"WITH {OBJECTS} SELECT object_id, r::INT AS row, c::INT AS column, round(x_min + (x_max - x_min) * (c + 0.5::DOUBLE) / 3, 6) AS u, round(y_min + (y_max - y_min) * (r + 0.5::DOUBLE) / 3, 6) AS v FROM objects, range(3) AS a(r), range(3) AS b(c)",
    "mean_directions": f"""
        WITH {OBJECTS}, m AS (SELECT scene_id, colour, count(*) AS n, avg(fx) AS x, avg(fy) AS y, round(avg(cx), 9) AS mean_cx, round(avg(cy), 9) AS mean_cy, round(avg(cz), 9) AS mean_cz, round(median(z_min), 9) AS low, round(median(z_max), 9) AS high FROM objects GROUP BY ALL)
        SELECT scene_id, colour, n, CASE WHEN sqrt(x * x + y * y) > 1e-12 THEN round(x / sqrt(x * x + y * y), 6) END AS mean_fx, CASE WHEN sqrt(x * x + y * y) > 1e-12 THEN round(y / sqrt(x * x + y * y), 6) END AS mean_fy, mean_cx, mean_cy, mean_cz, low, high FROM m
    """,
}
