"""Lines numbered over blocks, merged sessions, ragged rows with repeated headers."""

import json

from lodequery.sources import readers


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    wanted = {}
    for name, end in (("a.txt", "\n"), ("b.txt", "\r\n"), ("c.txt", "\n")):
        lines = [f"{name} {i} " + "é" * (i % 70) if i % 9 else "" for i in range(700)] if name != "c.txt" else ["only"]
        (tmp_path / name).write_bytes(end.join(lines).encode() + (end.encode() if name == "a.txt" else b""))
        wanted[name] = lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {}
        blocks = spark.read.text(str(tmp_path)).selectExpr("_metadata.file_block_start as b").distinct().count()
        for r in readers.numbered_lines(spark, str(tmp_path)).collect():
            got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line] = r.value
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert blocks > 10 and got == {name: dict(enumerate(lines, 1)) for name, lines in wanted.items()}


def test_sessions_are_merged_by_time(spark, tmp_path):
    times = {"session-1.jsonl": [5, 7, 7], "session-2.jsonl": [1, 7, 9], "notes.jsonl": [2]}
    for name, of in times.items():
        (tmp_path / name).write_text("".join(json.dumps({"seq": i, "utc_us": t, "ev": name}) + "\n\n" for i, t in enumerate(of)) + "[]\n")
    got = [(r.utc_us, r.ev, r.seq) for r in readers.merged_sessions(spark, str(tmp_path), r"session-\d+\.jsonl").collect()]
    assert got == sorted((t, name, i) for name, of in times.items() if name != "notes.jsonl" for i, t in enumerate(of))


def test_headers_and_samplers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,b\n1,2,3\n")
    (tmp_path / "h.csv").write_text("a,c,b\n1,2,3\n\n4\n")
    got = {(r.file.rsplit("/", 1)[1], r.row): r.fault for r in readers.ragged_csv(spark, str(tmp_path), ["a", "b", "c"], (3,)).collect()}
    assert got == {("t.csv", 0): "repeated_header", ("t.csv", 1): None, ("h.csv", 0): "wrong_header", ("h.csv", 1): None, ("h.csv", 3): "wrong_width"}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.txt").write_text('{"tz": 1}\n{"s": 1}\n\n{"s": 2}')
    assert sorted((r.line, r.header, r.sample) for r in readers.sampler(spark, str(tmp_path / "s")).collect()) == [(1, '{"tz": 1}', '{"s": 1}'), (3, '{"tz": 1}', '{"s": 2}')]
