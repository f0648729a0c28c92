"""Keyframes: the rule on hand-made samples, and the stream against one pass over them."""

import random

from lodequery.streaming import captures


def run(samples, rule=captures.Rule()):
    capture = captures.Capture(rule)
    return [(s[0], *k) for s in samples for k in [capture.add(*s)] if k]


def still(start, seconds, yaw, x=0.0, y=0.0, tracked=True, busy=False):
    return [(start + i / 10, yaw, x, y, tracked, busy) for i in range(int(seconds * 10))]


def test_rule():
    assert run(still(0, 0.5, 0)) == []
    assert run(still(0, 1, 0)) == [(0.5, 0, 0, "place")]
    assert run(still(0, 1, 0) + still(1, 1, 24) + still(2, 1, 26)) == [(0.5, 0, 0, "place"), (2.0, 0, 1, "direction")]  # 24 and 26 are one steady window
    assert run(still(0, 1, 179) + still(1, 1, -179)) == [(0.5, 0, 0, "place")]
    assert run(still(0, 1, 0) + still(1, 1, 0, x=1.4) + still(2, 1, 0, x=1.5)) == [(0.5, 0, 0, "place"), (2.5, 1, 0, "place")]
    assert run(still(0, 0.4, 0) + still(0.4, 0.1, 0, tracked=False) + still(0.5, 0.6, 0)) == [(1.0, 0, 0, "place")]
    assert [k[3] for k in run(still(0, 0.7, 0, busy=True) + still(0.7, 0.3, 0))] == ["refused", "refused", "place"]
    full = captures.Rule(frames=2, places=1)
    assert [k[1:] for k in run(still(0, 1, 0) + still(1, 1, 90) + still(2, 1, 180) + still(3, 1, 270, x=9.0), full)] == [(0, 0, "place"), (0, 1, "direction")]


def test_stream_equals_one_pass(spark, tmp_path):
    rng, rows = random.Random(9), []
    for scan in (1, 2, 3):
        yaw, x, t = 0.0, 0.0, 0.0
        for _ in range(40):
            yaw, x = captures.turn(yaw + rng.choice((10, 40, 100))), x + rng.choice((0.0, 0.0, 1.6))
            rows += [(scan, *s) for s in still(t, rng.choice((0.3, 1.0)), yaw, x, tracked=rng.random() > 0.1, busy=rng.random() > 0.7)]
            t = rows[-1][1] + 0.1
    schema = "scan bigint, t double, yaw double, x double, y double, tracked boolean, busy boolean"
    for part in range(5):
        spark.createDataFrame([r for r in rows if int(r[1]) % 30 // 6 == part and r[1] < 30], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{part}")
    once = {scan: run([r[1:] for r in rows if r[0] == scan and r[1] < 30]) for scan in (1, 2, 3)}
    (tmp_path / "in").mkdir()
    got = []
    for part in range(5):
        for f in (tmp_path / f"in{part}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{part}-{f.name}")
        stream = captures.keyframes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        query = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert {s: [(r.t, r.place, r.step, r.reason) for r in got if r.scan == s] for s in once} == once
    whole = captures.replayed(spark.createDataFrame([r for r in rows if r[1] < 30], schema).repartition(3)).orderBy("scan", "t").collect()
    assert {s: [(r.t, r.place, r.step, r.reason) for r in whole if r.scan == s] for s in once} == once
    assert {r.reason for r in got} == {"place", "direction", "refused"}
