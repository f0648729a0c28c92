"""Counts and texts made tile by tile against rows of all pairs and triples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery.functions import geometry, truth
from lodequery.operators import encoding, oriented, ranking, relations, tiles, turned


@pytest.fixture(scope="module")
def things(spark):
    """Three scenes in and out of order; some unknown centres, close centres, and an object alone."""
    rng, rows = np.random.default_rng(8), []
    for i in range(75):
        c = (rng.normal(size=3) * (0.15 if i % 3 == 2 else 1.0)).tolist() if i % 9 else [None] * 3
        size, front = rng.uniform(0.1, 1.0, 3).tolist(), ([0.0, 0.0] if i % 8 == 0 else rng.normal(size=2).tolist())
        rows.append((i % 3, (i * 37) % 75, ("table", "chair", "box", "lamp", None)[i % 5], ("red", "green", "blue")[i % 4 % 3], *c, *size, *front))
    rows.append((5, 1000, "chair", "red", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 1.0))
    df = spark.createDataFrame(rows, "scene_id bigint, object_id bigint, category string, colour string, cx double, cy double, cz double, sx double, sy double, sz double, fx double, fy double")
    sides = [(F.col(f"c{s}") + sign * F.col(f"s{s}") / 2).alias(f"{s}_{e}") for s in "xyz" for sign, e in ((-1, "min"), (1, "max"))]
    return df.select("*", *sides).cache()


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_between_counts_without_triples(spark, things, monkeypatch):
    monkeypatch.setattr(tiles, "CELLS", 40)
    monkeypatch.setattr(relations, "BETWEEN_TARGETS", 4)
    want = relations.state_counts(relations.between_rows(things), "scene_id", "target_id")
    assert rows_of(relations.between_counts(things)) == rows_of(want)
    plan = relations.between_counts(things)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and relations.between_counts(things.limit(0)).count() == 0  # rows and columns with the number of tiles, and no pairs


def test_turned_between_without_triples(spark, things, monkeypatch):
    monkeypatch.setattr(tiles, "CELLS", 40)
    monkeypatch.setattr(oriented, "BETWEEN_TARGETS", 4)
    spun = things.select("*", F.lit(0.1).alias("qx"), (F.col("object_id") % 7 / 7.0).alias("qy"), F.lit(0.3).alias("qz"), F.lit(1.0).alias("qw"))
    shapes = oriented.shaped(turned.turned(spun)).cache()
    rows = oriented.between(shapes)
    want = rows.groupBy("scene_id", "first_id", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("target_id").alias("targets"), F.sum("second_id").alias("seconds"))
    assert rows_of(oriented.between_totals(shapes)) == rows_of(want) and {r.state for r in want.collect()} == {"T", "U"}
    many = oriented.shaped(turned.turned(spun.filter("cx is not null").crossJoin(spark.range(3).toDF("k")).withColumn("object_id", F.col("object_id") + 100 * F.col("k")).withColumn("scene_id", F.lit(0).cast("bigint")))).cache()
    found = oriented.between(many).filter("state = 'U'").agg(F.count(F.lit(1)), F.sum("target_id"), F.sum("second_id")).first()
    assert tuple(found) == tuple(oriented.between_totals(many).filter("state = 'U'").agg(F.sum("n"), F.sum("targets"), F.sum("seconds")).first())  # 198 objects, so more than a byte counts
    plan = oriented.between_totals(shapes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and oriented.between(shapes.limit(0)).count() == 0  # rows and columns with the number of tiles, and no pairs


def test_directions_without_pairs(spark, things, monkeypatch):
    monkeypatch.setattr(tiles, "CELLS", 40)
    want = relations.state_counts(relations.direction_rows(things), "scene_id", "frame", "relation", "anchor_id")
    assert rows_of(relations.direction_counts(things)) == rows_of(want) and relations.direction_counts(things.limit(0)).count() == 0


def test_matrix_without_pairs(spark, things, monkeypatch):
    monkeypatch.setattr(tiles, "CELLS", 40)
    cells = relations.relation_rows(things).withColumn("cell", F.when(F.col("target_id") == F.col("anchor_id"), "-").otherwise(F.col("state")))
    want = cells.groupBy("scene_id", "relation", "target_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("anchor_id", "cell"))), lambda c: c["cell"]), "").alias("states"))
    assert rows_of(relations.matrix_rows(things)) == rows_of(want) and relations.matrix_rows(things.limit(0)).count() == 0


def test_a_scene_is_paired_in_tiles(spark, things, monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", 4)
    df = relations.pairs(things)
    assert df.rdd.getNumPartitions() > 10 and "ShuffledHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    assert df.select(F.countDistinct(F.struct("t.scene_id", "t.object_id", "a.object_id"))).first()[0] == df.count() == 3 * 25 * 25 + 1


def test_blocks_without_pairs(spark, things, monkeypatch):
    monkeypatch.setattr(tiles, "CELLS", 40)
    cells = relations.pairs(things, F.col("t.object_id") != F.col("a.object_id")).select(F.col("t.scene_id").alias("scene_id"), F.col("t.object_id").alias("row_id"), F.col("a.object_id").alias("column_id"), truth.spelled(truth.at_most(geometry.centre_distance(), 2.0, 0.02)).alias("state"))
    assert rows_of(encoding.near_blocks(things)) == rows_of(encoding.blocks(cells, ["scene_id"], "row_id", "column_id", "state"))
    assert rows_of(encoding.near_blocks(things, back=True)) == rows_of(cells)


@pytest.mark.parametrize("k,farthest", [(1, False), (2, False), (5, False), (1, True)])
def test_ranks_without_pairs(spark, things, monkeypatch, k, farthest):
    monkeypatch.setattr(tiles, "CELLS", 40)
    known = things.withColumns({f"c{s}": F.when(F.col("scene_id") > 0, F.coalesce(f"c{s}", F.lit(0.5))).otherwise(F.col(f"c{s}")) for s in "xyz"})
    want = ranking.ranked(ranking.candidate_rows(known, "chair"), ["scene_id", "anchor_id"], k, farthest)
    assert rows_of(ranking.ranked_near(known, "chair", k, farthest)) == rows_of(want) and want.select("status").distinct().count() >= 2


def test_uncertain_closest_without_memberships(spark, things, monkeypatch):
    monkeypatch.setattr(tiles, "CELLS", 40)
    known = things.withColumns({f"c{s}": F.when(F.col("scene_id") > 0, F.coalesce(f"c{s}", F.lit(0.5))).otherwise(F.col(f"c{s}")) for s in "xyz"})
    for limit, red in ((12, "colour = 'red' and object_id % 2 = 0"), (1, "colour = 'red'"), (12, "object_id < 20")):
        monkeypatch.setattr(ranking, "SUBSET_LIMIT", limit)
        rows = ranking.candidate_rows(known, "chair").join(known.select(F.col("object_id").alias("candidate_id"), F.expr(red).alias("possible")), "candidate_id")
        assert rows_of(ranking.nearest_uncertain(known, "chair", F.expr(red))) == rows_of(ranking.ranked_uncertain(rows, ["scene_id", "anchor_id"]))
