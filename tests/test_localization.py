"""Localization: planted scans are found again, doubtful links are left, and every kept detection belongs to one object."""

import math
from collections import Counter

import numpy as np
import pytest

from lodequery.operators import localization as loc

COLUMNS = "scan string, keyframe bigint, position bigint, detection bigint, time_us bigint, label string, category string, score double, x1 double, y1 double, x2 double, y2 double, width double, height double, fx double, fy double, cx double, cy double, px double, py double, pz double, qx double, qy double, qz double, qw double"
F, CX, CY = 500.0, 500.0, 400.0


def camera(at, yaw, pitch=0.0):
    """The tracker's pose (left-handed, y up) of a camera at a place of the scene (z up), turned by yaw and then tilted down by pitch."""
    cy, sy, cp, sp = math.cos(yaw / 2), math.sin(yaw / 2), math.cos(pitch / 2), math.sin(pitch / 2)
    return (at[0], at[2], at[1]), (cy * sp, sy * cp, -sy * sp, cy * cp)


def project(at, yaw, pitch, point):
    """Pixels of a scene point, worked out with plain rotations: right, down, ahead of the camera."""
    dx, dy, dz = (p - a for p, a in zip(point, at, strict=True))
    right, level = dx * math.cos(yaw) - dy * math.sin(yaw), dx * math.sin(yaw) + dy * math.cos(yaw)
    down, ahead = -dz * math.cos(pitch) - level * math.sin(pitch), level * math.cos(pitch) - dz * math.sin(pitch)
    return CX + F * right / ahead, CY + F * down / ahead, ahead


def seen(scan, keyframe, position, detection, at, yaw, pitch, thing, size, label="chair", score=0.9):
    corners = [project(at, yaw, pitch, [c + s * h / 2 for c, s, h in zip(thing, (i, j, k), size, strict=True)]) for i in (-1, 1) for j in (-1, 1) for k in (-1, 1)]
    u, v, _ = project(at, yaw, pitch, thing)
    half = (max(c[1] for c in corners) - min(c[1] for c in corners)) / 2
    p, q = camera(at, yaw, pitch)
    return (scan, keyframe, position, detection, keyframe * 1000, label, label if label != "odd" else None, score, *map(float, (u - 30 + 0.5, v - half + 0.5, u + 30 + 0.5, v + half + 0.5)), 1000.0, 800.0, F, F, CX, CY, *map(float, p), *q)


PRIORS = [("chair", True, 0.5, 0.5, 0.9)]
PRIOR = "category string, upright boolean, sx double, sy double, sz double"
PLACES = [((0.0, -3.0, 1.5), 0.0), ((3.0, 0.0, 1.5), -math.pi / 2), ((-3.0, 0.0, 1.5), math.pi / 2)]


def test_ray_passes_through_what_was_seen(spark):
    rows, things = [], []
    rng = np.random.default_rng(2)
    for i in range(30):
        at, yaw, pitch, thing = rng.normal(size=3), float(rng.uniform(-3, 3)), float(rng.uniform(-0.4, 0.4)), None
        while thing is None or project(at, yaw, pitch, thing)[2] < 1 or not all(50 < x < y for x, y in zip(project(at, yaw, pitch, thing)[:2], (950, 750), strict=True)):
            thing = rng.normal(size=3) * 4
        rows.append(seen("s", i, i, i, at, yaw, pitch, thing, (0.0, 0.0, 0.0)))
        things.append(thing)
    for r, thing in zip(loc.observed(spark.createDataFrame(rows, COLUMNS)).orderBy("keyframe").collect(), things, strict=True):
        away = np.array(thing) - np.array([r.ox, r.oy, r.oz])
        assert np.allclose(np.cross(away, [r.dx, r.dy, r.dz]), 0, atol=1e-6) and away @ [r.dx, r.dy, r.dz] > 0


def test_planted_objects_are_found(spark):
    things = [("chair", (0.3, 0.2, 0.45)), ("chair", (-0.9, 0.5, 0.45)), ("lamp", (0.5, -0.6, 1.2))]
    rows = [seen("a", 3 * p + k, p, n, at, yaw + turn, 0.1, thing, (0.5, 0.5, 0.9), label) for p, (at, yaw) in enumerate(PLACES) for k, turn in enumerate((-0.05, 0.0, 0.05)) for n, (label, thing) in enumerate(things)]
    rows += [seen("b", 0, 0, 0, *PLACES[0], 0.1, (0.1, 0.1, 0.45), (0.5, 0.5, 0.9))]  # seen from one place only: its prior gives the distance
    rows += [seen("c", 0, 0, 0, *PLACES[0], 0.0, (0.0, 0.0, 1.5), (0.1, 0.1, 0.1), "vase")]  # no prior, one place: no centre
    rows += [seen("a", 0, 0, 7, *PLACES[0], 0.1, (0.0, 0.0, 1.0), (0.1, 0.1, 0.1), "odd"), seen("a", 0, 0, 8, *PLACES[0], 0.1, (0.0, 0.0, 1.0), (0.1, 0.1, 0.1), score=0.1)]
    rows += [(*rows[0][:3], 9, 0, "chair", "chair", 0.9, 1.0, 50.0, 40.0, 90.0, *rows[0][12:]), (*rows[0][:3], 10, 0, None, None, None, *[None] * 17)]
    detections = spark.createDataFrame(rows, COLUMNS).repartition(3)
    objects = {(r.scan, r.object_id): r for r in loc.localized(detections, spark.createDataFrame(PRIORS, PRIOR)).collect()}
    a = [r for (scan, _), r in sorted(objects.items()) if scan == "a"]
    assert [r.category for r in a] == ["chair", "chair", "lamp"] and all(r.status == "multi_position" and r.positions == 3 and r.keyframes == 9 and not r.from_size for r in a)
    for r, (_, thing) in zip(a, sorted(things, key=lambda x: (x[0], x[1])), strict=True):
        assert np.allclose([r.cx, r.cy, r.cz], thing, atol=0.03)
    b, c = objects["b", "obj_001"], objects["c", "obj_001"]
    assert b.status == "single_position" and b.from_size and np.allclose([b.cx, b.cy, b.cz], (0.1, 0.1, 0.45), atol=0.25) and b.size_m == [0.5, 0.5, 0.9]
    assert c.cx is None and c.size_m is None and len(objects) == 5
    assert Counter((r.scan, r.fate, r.n) for r in loc.left_out(detections).collect()) == Counter([("a", "kept", 27), ("b", "kept", 1), ("c", "kept", 1), ("a", "unmapped_label", 2), ("a", "below_min_score", 1), ("a", "cut_by_the_edge", 1)])
    assert loc.localized(detections.limit(0), spark.createDataFrame(PRIORS, PRIOR)).count() == 0


def test_near_ties_are_left(spark):
    """Two lamps on one line of sight from the first place cannot be told apart there."""
    lamps = [(0.0, 0.0, 1.0), (0.03, 0.35, 1.0)]
    rows = [seen("a", 0, 0, 0, *PLACES[0], 0.0, lamps[0], (0.1, 0.1, 0.3), "lamp")]
    rows += [seen("a", 1, 1, n, (3.0, -1.0, 1.5), -math.pi / 2, 0.0, (0.0, 0.06 * n, 1.0), (0.1, 0.1, 0.3), "lamp") for n in range(2)]
    rows = [r if r[3] == 0 else (*r[:8], r[8] + 60, *r[9:10], r[10] + 60, *r[11:]) for r in rows]
    got = loc.localized(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(PRIORS, PRIOR)).collect()
    twins = {r.object_id: set(r.may_duplicate) for r in got}
    assert all(o in twins[t] for o in twins for t in twins[o])


def test_third_view_splits():
    """Of three rays, one that misses the others' point by far becomes a track of its own."""
    import pandas as pd

    point = np.array([0.0, 0.0, 1.0])
    origins = np.array([[0.0, -3, 1], [3, 0, 1], [-3, 0.0, 1], [0, 3.0, 1]])
    aims = np.array([point, point, point + [0, 0.9, 0], point])
    d = loc.unit(aims - origins)
    table = pd.DataFrame({"position": range(4), "lo": np.nan, "hi": np.nan, **{f"o{c}": origins[:, j] for j, c in enumerate("xyz")}, **{f"d{c}": d[:, j] for j, c in enumerate("xyz")}})
    tracks = loc.Tracks(loc.Rays(table))
    tracks.start(0)
    tracks.sightings[0] = [0, 1, 2, 3]
    tracks.refit(0)
    assert tracks.sightings == [[0, 1, 3], [2]] and np.allclose(tracks.centre[0], point) and tracks.twins == [{1}, {0}]
    assert tracks.attach(1.25) == [0, 1]  # a possible duplicate is left as it is
    tracks.twins = [set(), set()]
    assert tracks.attach(1.25) == [0] and tracks.attached[0] == [2]


def test_intervals_match_a_search():
    rng = np.random.default_rng(5)
    pose = np.stack([np.array([[1.0, 0, 0], [0, 0, 1], [0, -1, 0]])] * 20)
    direction = loc.unit(np.stack([rng.uniform(-0.3, 0.3, 20), np.ones(20), rng.uniform(-0.2, 0.2, 20)], 1))
    size, fy = np.tile([0.5, 0.4, 0.9], (20, 1)), np.full(20, F)
    lo, hi = loc.interval(rng.uniform(40, 300, 20), pose, direction, size, fy)
    rng = np.random.default_rng(5)
    rng.uniform(-0.3, 0.3, 20), rng.uniform(-0.2, 0.2, 20)
    wanted = rng.uniform(40, 300, 20)
    for i in range(20):
        found = []
        for k in range(loc.TURNS):
            grid = np.linspace(loc.NEAR, loc.FAR, 20001)
            h = loc.heights(grid, np.repeat(pose[i : i + 1], 20001, 0), np.repeat(direction[i : i + 1], 20001, 0), np.repeat(size[i : i + 1], 20001, 0), k * np.pi / loc.TURNS, np.full(20001, F))
            if h[0] >= wanted[i] >= h[-1]:
                found.append(grid[np.flatnonzero(h > wanted[i])[-1]])
        assert (np.isnan(lo[i]) and not found) or (abs(lo[i] - min(found)) < 1e-3 and abs(hi[i] - max(found)) < 1e-3)
