"""Releases: names decide before anything is read, in folders and zip files; strict documents and their faults in place."""

import io
import json
import os
import random
import zipfile

import pytest

from lodequery.sources import releases, strict


def put(path, data=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


@pytest.fixture
def release(tmp_path):
    for scene in ("aa_1", "bb_2", "cc{3"):
        for kind in releases.KINDS:
            put(f"{tmp_path}/set/{scene}/{scene}_{kind}", f"{scene} {kind}".encode())
    put(f"{tmp_path}/set/aa_1/other_scene_graph.json")
    put(f"{tmp_path}/set/aa_1/notes.txt", b"aa_1\n")
    put(f"{tmp_path}/set/splits/train.txt", b"aa_1\r\nbb_2\n\n")
    put(f"{tmp_path}/set/splits/readme.TXT", b"some words\n")
    put(f"{tmp_path}/set/big.bin", b"y" * 1000)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for scene in ("dd_4", "ee_5"):
            for kind in releases.KINDS[: 4 if scene == "dd_4" else 2]:
                z.writestr(f"deep/{scene}/{scene}_{kind}", f"{scene} {kind} " + "z" * 500)
        z.writestr("deep/train.txt", "dd_4\nee_5\n")
        z.writestr("deep/photo.jpg", "w" * 500)
    raw = bytearray(data.getvalue())
    put(f"{tmp_path}/set/more.zip", bytes(raw))
    return f"{tmp_path}/set"


def test_members(spark, release):
    files = releases.members(spark, release).cache()
    held = {(r.scene, r.kind): bytes(r.content).split(b" z")[0] for r in files.filter("kind is not null").collect()}
    assert held == {(s, k): f"{s} {k}".encode() for s in ("aa_1", "bb_2", "cc{3", "dd_4", "ee_5") for k in releases.KINDS if s != "ee_5" or k in releases.KINDS[:2]}
    told = {r.name.rsplit("/", 1)[1]: (r.official, r.lines) for r in releases.lists(files.filter("container is null"), r"[a-z]{2}_\d").collect()}
    assert told == {"train.txt": (True, ["aa_1", "bb_2"]), "readme.TXT": (False, None), "notes.txt": (False, None)}
    assert {r.scene: r.missing for r in releases.missing_files(files).collect() if r.missing} == {"ee_5": list(releases.KINDS[2:])}


def test_pruned_members_are_not_read(spark, release):
    """Files of other scenes cannot be opened, and members of other scenes are damaged: the wanted scenes read all the same."""
    with open(f"{release}/more.zip", "r+b") as f:
        whole = f.read()
        with zipfile.ZipFile(io.BytesIO(whole)) as z:
            info = z.getinfo(f"deep/ee_5/ee_5_{releases.KINDS[0]}")
        f.seek(info.header_offset + 30 + len(info.filename) + 3)
        f.write(b"\xff\xff\xff\xff")
    for kind in releases.KINDS:
        os.remove(f"{release}/bb_2/bb_2_{kind}")
        os.symlink("/nowhere/at/all", f"{release}/bb_2/bb_2_{kind}")  # listing leaves it out, opening it would fail
    files = releases.members(spark, release, ["aa_1", "cc{3", "dd_4"])
    assert {r.scene for r in files.filter("kind is not null").collect()} == {"aa_1", "cc{3", "dd_4"}
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", releases._glob(["aa_1"])).load(release)
    names = {f.rsplit("/", 1)[1] for f in found.inputFiles()}
    assert not any(x.startswith(("bb_2", "cc", "big")) for x in names) and f"aa_1_{releases.KINDS[0]}" in names
    with pytest.raises(Exception, match="zlib|CRC|invalid"):
        releases.members(spark, release, ["ee_5"]).collect()


def test_entries_against_brute_force(spark):
    rng = random.Random(9)
    entry = lambda **more: {k: None for k in releases.ENTRY} | {"target_index": "1", "target_class": "a", "distractor_ids": [], "anchors": {}} | more
    odd = [None, 3, "x", [], {}, {"target_index": "1"}, entry(extra=1)]
    documents, objects = [], []
    for s in range(12):
        for i in range(8):
            objects.append((f"s{s}", str(i), rng.choice("012"), rng.choice("ab")))
        regions = {}
        for region in "012":
            texts = {}
            for t in range(rng.randrange(5)):
                made = [
                    rng.choice(odd) if rng.random() < 0.15 else entry(
                        target_index=rng.choice(["1", "2", "3", "99", 1, None]), target_class=rng.choice(["a", "b", None]), distractor_ids=rng.choice([[], ["4"], ["4", "98"], "4", None, [4]]),
                        anchors=rng.choice([{}, {"anchor_1": {"index": "5"}}, {"anchor_1": {"index": "6"}, "anchor_2": {"index": "97"}}, {"anchor_1": "5"}, [], None]),
                    )
                    for _ in range(rng.randrange(4))
                ]
                texts[rng.choice(["", f"t{t}", f"t{t}"])] = rng.choice([made, made, made, {}, "no list"])
            regions[region] = rng.choice([texts, texts, texts, [1], None])
        documents.append((f"s{s}", json.dumps({"scene_name": f"s{s}", "regions": regions})))
    by = {(s, i): (r, label) for s, i, r, label in objects}

    def code_of(scene, region, e):
        if not isinstance(e, dict) or sorted(e) != list(releases.ENTRY):
            return releases.CODES[0]
        at = lambda i: by.get((scene, i), (None, None)) if isinstance(i, str) else (None, None)
        if at(e["target_index"])[0] != region:
            return releases.CODES[1]
        if e["target_class"] != at(e["target_index"])[1]:
            return releases.CODES[2]
        if not isinstance(e["distractor_ids"], list) or any(at(x)[0] is None for x in e["distractor_ids"]):
            return releases.CODES[3]
        anchors = e["anchors"]
        if not isinstance(anchors, dict) or any(not isinstance(a, dict) or at(a.get("index"))[0] is None for a in anchors.values()):
            return releases.CODES[4]
        return releases.CODES[5] if any(at(a["index"])[0] != region for a in anchors.values()) else None

    want = {}
    for scene, document in documents:
        codes, texts, several = [], 0, 0
        for region, block in json.loads(document)["regions"].items():
            if not isinstance(block, dict):
                codes.append(releases.CODES[0])
                continue
            for text, made in block.items():
                if not text or not isinstance(made, list) or not made:
                    codes.append(releases.CODES[0])
                    continue
                found = [code_of(scene, region, e) for e in made]
                codes += found
                texts, several = texts + (None in found), several + (found.count(None) > 1)
        if codes:
            want[scene] = (texts, codes.count(None), several, *(codes.count(c) for c in releases.CODES))
    statements = spark.createDataFrame([*documents, ("bad", "{"), ("none", None)], "scene string, document string")
    judged = releases.judged(releases.entries(statements), spark.createDataFrame(objects, "scene string, object_id string, region string, label string"))
    got = {r[0]: tuple(r)[1:] for r in releases.scene_counts(judged).collect()}
    assert got == want and len({c for x in got.values() for c, n in zip(releases.CODES, x[3:], strict=True) if n}) == 6
    assert releases.scene_counts(releases.judged(releases.entries(statements.limit(0)), spark.createDataFrame([], "scene string, object_id string, region string, label string"))).count() == 0


def test_strict_documents(spark, tmp_path):
    cases = {
        "a.json": (b'{"a": [1, {"b": null}]}', None, None), "b.json": (b"\xef\xbb\xbf{}", "E_PARSE_ENCODING", "byte-order mark"), "c.json": (b'{"a": "\xff"}', "E_PARSE_ENCODING", "at byte 7"),
        "d.json": (b'{"a": 1, "c": {"b": 1, "b": 2}}', "E_PARSE_DUPLICATE_KEY", "'b'"), "e.json": (b'{"a": NaN}', "E_NONFINITE", "NaN"), "f.json": (b"[1e999]", "E_NONFINITE", "1e999"),
        "g.json": (b'{"a": 1,\n  }', "E_PARSE_JSON", "line 1"), "h.json": (b"null", None, None), "i.json": (b"[" * 100_000, "E_PARSE_JSON", ""),
    }
    for name, (data, _, _) in cases.items():
        put(f"{tmp_path}/deep/{name}", data)
    got = {r.file.rsplit("/", 1)[1]: r for r in strict.documents(spark, str(tmp_path)).collect()}
    assert got.keys() == cases.keys()
    for name, (data, code, message) in cases.items():
        assert got[name].code == code and (got[name].document == data.decode() if code is None else message in got[name].message), name

    def layer(sound):
        from pyspark.sql import functions as F

        return sound.filter("document = 'null'").select("file", F.lit("$").alias("path"), F.lit("E_RECORD_TYPE").alias("code"), F.lit("not an object").alias("message"))

    found = {(r.file.rsplit("/", 1)[1], r.code) for r in strict.issues(strict.documents(spark, str(tmp_path)), layer).collect()}
    assert found == {(n, c) for n, (_, c, _) in cases.items() if c} | {("h.json", "E_RECORD_TYPE")}
    assert strict.parsed(spark.createDataFrame([("x", None)], "file string, content binary")).first().code == "E_PARSE_ENCODING"
