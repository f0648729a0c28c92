"""Greedy pairs, box suppression and the bootstrap against their definitions."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from lodequery.binding import outcomes
from lodequery.operators import estimates, matching


def test_greedy_pairs(spark):
    rng = random.Random(11)
    rows = [(g, a, b, float(rng.randrange(5))) for g in range(6) for a in range(6) for b in range(6) if rng.random() < 0.5]
    got = {(r.g, r.left_id, r.right_id) for r in matching.greedy_pairs(spark.createDataFrame(rows, "g int, left_id bigint, right_id bigint, score double"), ["g"]).collect()}
    place = lambda r: (-r[3], r[1], r[2])
    for r in rows:  # a pair is kept exactly if no kept pair before it shares a side
        blocked = any((s[0], s[1], s[2]) in got and s[0] == r[0] and (s[1] == r[1] or s[2] == r[2]) and place(s) < place(r) for s in rows)
        assert (r[:3] in got) == (not blocked)


def test_suppression(spark):
    rng, rows = random.Random(12), []
    for image in range(8):
        for box in range(25):
            x, y = rng.uniform(0, 60), rng.uniform(0, 60)
            rows.append((image, box, float(rng.randrange(6)), x, y, x + rng.uniform(5, 40), y + rng.uniform(5, 40)))
    got = {(r.image, r.box_id) for r in matching.suppressed(spark.createDataFrame(rows, "image int, box_id bigint, score double, x_min double, y_min double, x_max double, y_max double"), ["image"]).collect()}

    def ratio(a, b):
        side = lambda i: max(0, min(a[i + 2], b[i + 2]) - max(a[i], b[i]) + 1)
        area = lambda r: (r[5] - r[3] + 1) * (r[6] - r[4] + 1)
        both = side(3) * side(4)
        return both / (area(a) + area(b) - both)

    for r in rows:
        covered = any(s[:2] in got and s[0] == r[0] and (-s[2], s[1]) < (-r[2], r[1]) and ratio(s, r) > 0.45 for s in rows)
        assert (r[:2] in got) == (not covered)


def test_bootstrap(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(c, float(rng.randrange(2))) for c in range(7) for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "c int, y double")
    source, means = random.Random(5), []
    for _ in range(100):
        picked = [source.choice(range(7)) for _ in range(7)]
        values = [y for p in picked for c, y in rows if c == p]
        means.append(sum(values) / len(values))
    means.sort()
    want = (round(means[2], 9), round(means[97], 9), 100)
    assert tuple(estimates.bootstrap(df, "c", "y", 100, 5).first()) == want
    monkeypatch.setattr(estimates, "BROADCAST_ROWS", 0)
    assert tuple(estimates.bootstrap(df, "c", "y", 100, 5).first()) == want


def test_registered_bootstrap_has_the_reference_replicates(spark, sf_dir):
    per = defaultdict(list)
    for r in outcomes(spark, sf_dir).select("environment", "first").collect():
        per[r.environment].append(r.first)
    names, source, means = sorted(per), random.Random(20261010), []
    sums = {e: (sum(v), len(v)) for e, v in per.items()}
    for _ in range(10_000):
        picked = [sums[names[source.randrange(len(names))]] for _ in names]
        means.append(sum(u for u, _ in picked) / sum(n for _, n in picked))
    means.sort()
    assert tuple(estimates.q_bootstrap(spark, sf_dir).first()) == (round(means[249], 9), round(means[9749], 9), 10_000)


def test_points_are_assigned_without_a_matrix(spark):
    rng = np.random.default_rng(6)
    rows = [(g, i, bool(rng.random() < (0.3, 0.6)[g]), *rng.normal(size=3).tolist()) for g in range(2) for i in range(60)]
    points = spark.createDataFrame(rows, "g int, id bigint, left boolean, cx double, cy double, cz double").cache()
    t, a = points.filter("left").alias("t"), points.filter("not left").alias("a")
    cost = F.round(F.sqrt(F.expr("pow(t.cx - a.cx, 2) + pow(t.cy - a.cy, 2) + pow(t.cz - a.cz, 2)")), 6)
    costs = t.join(a, F.expr("t.g = a.g")).select("t.g", F.col("t.id").alias("left_id"), F.col("a.id").alias("right_id"), cost.alias("cost")).filter("cost <= 1.2")
    got = {tuple(r) for r in matching.assigned_points(points, "g", 1.2).collect()}
    assert got == {tuple(r) for r in matching.assignments(costs, ["g"]).collect()} and len(got) > 20
    assert "Join" not in matching.assigned_points(points, "g", 1.2)._jdf.queryExecution().optimizedPlan().toString()


def test_suppression_takes_groups_together(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(None if i % 7 == 6 else i % 7, i, None if i % 50 == 0 else round(float(rng.random()), 1), *rng.integers(0, 60, 2).tolist(), 40) for i in range(400)]
    df = spark.createDataFrame(rows, "image int, box_id bigint, score double, x_min long, y_min long, side int").selectExpr("image", "box_id", "score", "double(x_min) x_min", "double(y_min) y_min", "double(x_min + side) x_max", "double(y_min + side) y_max")
    want = set()
    for image in [*range(6), None]:
        kept = []
        for b in sorted((r for r in df.collect() if r.image == image), key=lambda r: (r.score is None, -(r.score or 0), r.box_id)):
            w = [max(0, min(b.x_max, k.x_max) - max(b.x_min, k.x_min) + 1) * max(0, min(b.y_max, k.y_max) - max(b.y_min, k.y_min) + 1) for k in kept]
            if all(x / (2 * 41 * 41 - x) <= 0.45 for x in w):
                kept.append(b)
        want |= {(image, b.box_id) for b in kept}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    for most in (1, 1 << 17):
        monkeypatch.setattr(matching, "SUPPRESSED_AT_ONCE", most)
        assert {(r.image, r.box_id) for r in matching.suppressed(df, ["image"]).collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in matching.suppressed(df, ["image"])._jdf.queryExecution().executedPlan().toString()
