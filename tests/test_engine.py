"""The engine's queries against DuckDB, and what SQL cannot express against brute force."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery import catalog
from lodequery.functions import geometry, truth
from lodequery.operators import intervals, matching, ranking
from lodequery.plans.resolution import Query, ordered
from lodequery.sources import readers
from lodequery.streaming import streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, columns):
    spell = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.7g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(spell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = catalog.QUERIES[name](spark, sf_dir), duck.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.SQL.keys()))
def test_query_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).limit(1).collect()


def test_kleene(spark):
    values = spark.createDataFrame([(a, b) for a in (True, False, None) for b in (True, False, None)], "a boolean, b boolean")
    rows = values.select("a", "b", truth.all_of(F.col("a"), F.col("b")).alias("c"), truth.any_of(F.col("a"), F.col("b")).alias("d")).collect()
    for r in rows:
        both = {r.a, r.b}
        assert r.c == (False if False in both else None if None in both else True) and r.d == (True if True in both else None if None in both else False)
    x = spark.createDataFrame([(0.4,), (0.48,), (0.49,), (0.52,), (0.53,), (None,)], "x double")
    assert [r[0] for r in x.select(truth.spelled(truth.at_most(F.col("x"), 0.5, 0.02))).collect()] == list("TTUUFU")


def test_uncertain_rank_is_every_membership(spark):
    rng, rows = random.Random(3), []
    for g in range(25):
        rows += [(g, c, round(rng.uniform(0, 1), 2), rng.random() < 0.4) for c in range(rng.randrange(1, 6))]
    got = {r.g: (r.status, list(r.object_ids)) for r in ranking.ranked_uncertain(spark.createDataFrame(rows, "g int, candidate_id bigint, distance_m double, possible boolean"), ["g"]).collect()}

    def outcome(members):
        order = sorted((d, c) for c, d in members)
        if not order:
            return "no_match", []
        n = 1
        while n < len(order) and not order[n][0] - order[n - 1][0] > 0.05:
            n += 1
        return ("resolved" if n == 1 else "ambiguous"), sorted(c for _, c in order[:n])

    for g in {r[0] for r in rows}:
        sure, maybe = [(c, d) for h, c, d, p in rows if h == g and not p], [(c, d) for h, c, d, p in rows if h == g and p]
        seen = {(s, tuple(i)) for k in range(len(maybe) + 1) for extra in itertools.combinations(maybe, k) for s, i in [outcome(sure + list(extra))]}
        agreed = next(iter(seen)) if len(seen) == 1 else ("insufficient_information", ())
        assert got[g] == (agreed[0], list(agreed[1]))


def test_greedy_as_of(spark):
    left = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3)], "k int, t bigint, left_id bigint")
    right = spark.createDataFrame([(1, 5, 1), (1, 21, 2), (1, 22, 3)], "k int, t bigint, right_id bigint")
    assert {(r.left_id, r.right_id, r.waited) for r in intervals.greedy_as_of(left, right, ["k"]).collect()} == {(1, 2, 11), (2, 3, 2), (3, None, None)}


def test_assignment_is_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(60):
        shape = rng.integers(1, 5, 2)
        cost = rng.integers(0, 20, shape).astype(float)
        got = matching.assigned(cost)
        small = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(small[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert len(got) == min(shape) and sum(cost[r, c] for r, c in got) == best
    assert matching.assigned(np.array([[np.inf, 1.0], [np.inf, 2.0]])) == [(0, 1)]


def test_polygons():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2.0]])
    assert geometry.area(geometry.hull(np.vstack([square, [[1, 1], [2, 1]]]))) == 4
    assert geometry.area(geometry.clipped(square, square + 1)) == pytest.approx(1)
    turned = geometry.corners(np.zeros((1, 3)), np.ones((1, 3)), np.array([[0, 0, math.sin(math.pi / 8), math.cos(math.pi / 8)]]))[0]
    assert turned[:, 0].max() == pytest.approx(math.sqrt(0.5)) and geometry.area(geometry.hull(turned[:, :2])) == pytest.approx(1)


def test_query_order_and_faults():
    door, chair = Query("door", "door"), Query("chair", "chair", constraints=(("near", "door"),))
    assert [n.name for n in ordered((chair, door))] == ["door", "chair"]
    for nodes, fault in (((chair,), "unknown_anchor"), ((Query("a", constraints=(("near", "b"),)), Query("b", constraints=(("near", "a"),))), "cycle"), ((door, door), "duplicate_node"), ((door, Query("x", constraints=(("beside", "door"),))), "unknown_relation")):
        with pytest.raises(ValueError, match=fault):
            ordered(nodes)


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"seq":0,"ev":"session.start","utc_us":1}\n\n[1]\n{"seq":1,"ev":"x"}\nnot json\n')
    rows = readers.event_lines(spark, str(tmp_path / "a.jsonl")).orderBy("line").collect()
    assert [(r.line, r.seq, r.fault) for r in rows] == [(1, 0, None), (3, None, "not_an_event"), (4, 1, None), (5, None, "not_an_event")]
    (tmp_path / "b.csv").write_text("a,b,c\n1,2\n1,2,3\n1\n")
    assert [r.fault for r in readers.ragged_csv(spark, str(tmp_path / "b.csv"), ["a", "b", "c"], (2, 3)).orderBy("row").collect()] == [None, None, None, "wrong_width"]
    (tmp_path / "q.csv").write_text('a,b,c\n"1,5",2\n"a ""b""",,"x"\n,"",5" tall\n"open,2\n')
    cells = [r.cells for r in readers.ragged_csv(spark, str(tmp_path / "q.csv"), ["a", "b", "c"], (2, 3)).orderBy("row").collect()]
    assert cells[1:] == [["1,5", "2"], ['a "b"', "", "x"], ["", "", '5" tall'], ['"open', "2"]]
    (tmp_path / "c.json").write_text('{"a":1,"a":2}')
    assert [r.fault for r in readers.json_documents(spark, str(tmp_path / "c.json")).collect()] == ["not_strict_json"]


def test_stream_equals_replay(spark, tmp_path):
    rng, rows = random.Random(4), []
    for frame in range(8):
        rows += [(s, frame, c, x + rng.uniform(-0.05, 0.05), 0.0, 0.0) for s in (1, 2) for c, x in (("chair", 0.0), ("chair", 3.0), ("table", 6.0))]
    schema = "scan bigint, frame int, category string, x double, y double, z double"
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 2 == part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.associated(spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("tracked").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.scan, r["index"]): (r.category, r.seen) for r in spark.table("tracked").orderBy("seen").collect()}
    tracker = streams.Tracker([], 0.8, 0.2)
    for _, frame, c, x, y, z in sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1], *r[2:])):
        tracker.add(frame, c, x, y, z)
    assert {got[1, i] for i in range(3)} == {(o[0], o[4]) for o in tracker.objects} == {("chair", 8), ("table", 8)}
