"""Objects of a stream equal a replay for any split of its input; the rules of joining and merging one by one."""

import random

import pytest

from lodequery.streaming import object_state as state

SCHEMA = "scan bigint, frame bigint, detection bigint, category string, x double, y double, z double, sx double, sy double, sz double, score double"


def sightings(seed, scans=3, frames=14):
    rng, rows = random.Random(seed), []
    for scan in range(scans):
        places = [(rng.choice(["table", "chair", "cup", "bottle", "lamp"]), [rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0, 1)]) for _ in range(12)]
        for frame in range(frames):
            for d, (kind, at) in enumerate(rng.sample(places, 5)):
                rows.append((scan, frame, d, rng.choice([kind, kind, "cup"]), *(p + rng.gauss(0, 0.08) for p in at), *(rng.uniform(0.1, 0.9) for _ in range(3)), rng.random()))
    return rows


def settled(rows):
    return sorted((r.scan, r.object, r.category, round(r.x_min, 9), round(r.z_max, 9), r.sightings, r.frames, r.confirmed, r.late, r.unusable) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_replay_for_any_split(spark, tmp_path, seed):
    rows, rng = sightings(seed), random.Random(seed)
    rows.sort(key=lambda r: (r[1], r[0], r[2]))
    cuts = sorted(rng.sample(range(1, len(rows)), 4))  # frames are cut in two as well
    latest = {}

    def keep(batch, _):
        new = {}
        for r in batch.collect():
            new.setdefault(r.scan, []).append(r)
        latest.update(new)

    for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[i:j], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        state.tracked(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    whole = state.replayed(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert settled(r for x in latest.values() for r in x) == settled(whole) and any(r.confirmed for r in whole) and len({r.sightings for r in whole}) > 3


def scan_of(*rows, settings=state.Settings()):
    scan = state.Scan(settings)
    scan.add([(frame, d, category, list(at), [size] * 3, 0.5) for d, (frame, category, at, size) in enumerate(rows)])
    return scan.rows()


def test_rules():
    assert len(scan_of((0, "lamp", (0, 0, 0), 0.2), (0, "lamp", (0.05, 0, 0), 0.2))) == 2  # two of a kind in one frame are two
    assert [r[8] for r in scan_of((0, "lamp", (0, 0, 0), 0.2), (1, "lamp", (0.05, 0, 0), 0.2))] == [2]
    assert [r[1] for r in scan_of((0, "cup", (0, 0, 0), 0.2), (1, "bottle", (0, 0, 0), 0.2), (2, "bottle", (0, 0, 0), 0.2))] == ["bottle"]  # most votes
    assert [r[1] for r in scan_of((0, "cup", (0, 0, 0), 0.2), (1, "bottle", (0, 0, 0), 0.2))] == ["bottle"]  # a tie goes to the first by name
    assert len(scan_of((0, "lamp", (0, 0, 0), 0.2), (1, "chair", (0, 0, 0), 0.2))) == 2
    assert len(scan_of((0, "bed", (0, 0, 0.2), 0.4), (1, "chair", (0, 0, 0.85), 0.1))) == 1  # furniture rests on furniture
    assert len(scan_of((0, "lamp", (0, 0, 0.2), 0.4), (1, "lamp", (0, 0, 0.85), 0.1))) == 2
    smaller = scan_of((0, "table", (0, 0, 0), 4.0), (0, "chair", (1, 1, 0), 0.5), (1, "chair", (1, 1, 0), 0.4))
    assert sorted((r[1], r[8]) for r in smaller) in ([("chair", 2), ("table", 1)], [("chair", 3)])
    assert [(r[9], r[10]) for r in scan_of(*[(f, "lamp", (0, 0, 0), 0.2) for f in range(3)])] == [(3, True)]
    # three in a row, each close to the next: the gap closes and all merge into the first
    assert [r[8] for r in scan_of((0, "lamp", (0, 0, 0), 0.2), (1, "lamp", (0.38, 0, 0), 0.2), (2, "lamp", (0.19, 0, 0), 0.2))] == [3]


def test_late_and_unusable_rows():
    scan = state.Scan(state.Settings())
    scan.add([(5, 0, "lamp", [0.0] * 3, [0.2] * 3, None), (None, 0, "lamp", [0.0] * 3, [0.2] * 3, 1.0), (5, 1, None, [0.0] * 3, [0.2] * 3, 1.0), (5, 2, "lamp", [None, 0.0, 0.0], [0.2] * 3, 1.0)])
    again = state.Scan(state.Settings(), scan.text())
    again.add([(4, 0, "lamp", [0.0] * 3, [0.2] * 3, 1.0)])
    assert [(r[8], r[12], r[13]) for r in again.rows()] == [(1, 1, 3)]


def test_empty_table(spark):
    assert state.replayed(spark.createDataFrame([], SCHEMA)).count() == 0
