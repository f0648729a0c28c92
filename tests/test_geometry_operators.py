"""Size ranges, fitted boxes, packing and components against brute force."""

import random

import numpy as np

from lodequery.operators import clusters, rays, series


def test_size_ranges_explain_the_height():
    rng = np.random.default_rng(5)
    size, seen = rng.uniform(0.3, 1.5, (40, 3)), rng.uniform(60, 400, 40)
    ahead, focal = np.tile([0.0, 0.0, 1.0], (40, 1)), np.full(40, 500.0)
    lo, hi = rays.distance_interval(seen, ahead, size, focal)
    turns = [k * np.pi / rays.TURNS for k in range(rays.TURNS)]
    grid = np.linspace(rays.NEAR, rays.FAR, 4000)
    for i in range(40):
        one = lambda r: [np.tile(v[i], (len(r), 1)) for v in (ahead, size)]
        found = []
        for turn in turns:
            height = rays.heights(grid, *one(grid), turn, np.full(len(grid), 500.0))
            if height[0] >= seen[i] >= height[-1]:
                found.append(grid[np.argmax(height <= seen[i])])
        assert np.isnan(lo[i]) == (not found)
        if found:
            assert abs(lo[i] - min(found)) < 0.005 and abs(hi[i] - max(found)) < 0.005
    assert np.isnan(rays.distance_interval(np.array([0.0, np.nan]), ahead[:2], size[:2], focal[:2])[0]).all()


def test_fitted_box_finds_the_turn(spark):
    rng, rows, sides = np.random.default_rng(6), [], {}
    for box, turn in enumerate((0, 17, 45, 80)):
        t = rng.uniform(0, 1, 400)
        u, w = np.where(t < 0.66, rng.uniform(-1, 1, 400), 1.0), np.where(t < 0.66, 0.5, rng.uniform(-0.5, 0.5, 400))
        c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
        sides[box] = [high - low for low, high in (rays.trimmed(u, 0.03), rays.trimmed(w, 0.03))]
        rows += [(box, float(a * c + b * s), float(-a * s + b * c)) for a, b in zip(u, w)]
    points = spark.createDataFrame(rows, "box int, x double, z double")
    got = {r.box: r for r in rays.fitted_boxes(points, ["box"]).collect()}
    for box, turn in enumerate((0, 17, 45, 80)):
        assert got[box].n == 400 and abs(got[box].turn - turn) <= 1
        assert np.allclose([got[box].length, got[box].width], sides[box], atol=0.05)
    thin = {r.box: r for r in rays.fitted_boxes(points, ["box"], most=144).collect()}
    for box, turn in enumerate((0, 17, 45, 80)):
        assert thin[box].n == 400 and abs(thin[box].turn - turn) <= 5 and np.allclose([thin[box].length, thin[box].width], sides[box], atol=0.32)
    single = rays.fitted_boxes(spark.createDataFrame([(1, 2.0, 3.0)] * 3, "box int, x double, z double"), ["box"]).first()
    assert (single.n, single.turn, single.length, single.width) == (3, 0, rays.LEAST_SIDE, rays.LEAST_SIDE)


def test_links_are_all_pairs_that_pass(spark):
    parallel = [(1, "chair", 0, 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, "chair", 1, 2, 0.0, 0.1, 0.0, 1.0, 0.0, 0.0)]
    crossing = [(2, "chair", 0, 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (2, "chair", 1, 2, 3.0, -3.0, 0.2, 0.0, 1.0, 0.0), (2, "table", 2, 3, 3.0, 3.0, 0.0, 0.0, -1.0, 0.0), (2, "chair", 0, 4, 3.0, 3.0, 0.0, 0.0, -1.0, 0.0)]
    df = spark.createDataFrame(parallel + crossing, "scene_id int, category string, position int, ray_id int, ox double, oy double, oz double, dx double, dy double, dz double").selectExpr("*", "cast(null as double) lo", "if(ray_id = 9, 1.0D, null) hi")
    assert [(r.scene_id, r.a_id, r.b_id, round(r.gap_m, 6)) for r in rays.links(df, ["scene_id"]).collect()] == [(2, 1, 2, 0.2)]


def test_components(spark):
    rng = random.Random(7)
    links = [(g, *sorted(rng.sample(range(60), 2))) for g in (1, 2) for _ in range(45)] + [(3, i, i + 1) for i in range(59)]
    points = spark.createDataFrame([(g, i) for g in (1, 2, 3) for i in range(60)], "g int, id int")
    got = {(r.g, r.id): r.root for r in clusters.components(points, spark.createDataFrame(links, "g int, first_id int, second_id int"), ["g"]).collect()}
    want = {k: k[1] for k in got}
    for _ in range(60):
        for g, a, b in links:
            want[g, a] = want[g, b] = min(want[g, a], want[g, b])
    assert got == want and len(got) == 180


def test_packing_carries_over_batches(spark):
    rng = random.Random(8)
    rows = [(g, i, rng.randrange(0, 120)) for g in range(3) for i in range(70)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = series.packed(spark.createDataFrame(rows, "g int, i int, cost bigint"), ["g"], ["i"], "cost", 100).toPandas().sort_values(["g", "i"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in range(3):
        number, total, want = 0, 0, []
        for _, _, cost in [r for r in rows if r[0] == g]:
            if want and total + cost > 100:
                number, total = number + 1, 0
            total += cost
            want.append(number)
        assert got[got.g == g]["slice"].tolist() == want
