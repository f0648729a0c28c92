"""All contract rules on records with random faults, against a walk over each record by itself."""

import copy
import json
import math
import random
from collections import Counter

from lodequery.operators import contract

WORDS = ("table", "chair", "box")


def known(value, kind="annotated", source="d", assumptions=(), **more):
    return {"state": "known", "value": value, **more, "evidence": {"kind": kind, "source": source, "assumptions": list(assumptions)}}


def unknown(reason="not_in_source", source="d"):
    return {"state": "unknown", "reason": reason, "source": source}


def thing(rng, i, version, profile):
    s, kind = ("c", "inferred") if version == 3 else ("d", "annotated")
    word = rng.choice(WORDS)
    lost = "not_estimated" if version == 3 else "not_in_source"
    withheld = unknown("withheld_by_profile", "p") if profile == "restricted" else None
    out = {
        "object_id": f"o{i}", "source_ref": {"source_id": s, "source_label": word}, "category": known({"standard": word, "model": word}, kind, s),
        "geometry": {
            "center_m": known([1.0, 2.0, 3.0], kind, s, ["a1"] if version == 3 else []), "size_m": known([1.0, 1.0, 1.0], "assumed", "q", ["a1"]) if profile != "annotated" else known([1.0, 1.0, 1.0]),
            "rotation_xyzw": withheld or (unknown(lost, s) if version == 3 else known([0.0, 0.0, 0.6, 0.8], kind, s, support="yaw_only")),
        },
        "semantic_front": withheld or (unknown(lost, s) if version == 3 else known([0.6, 0.8], kind, s)), "attributes": {"colours": withheld or (known(["red"], kind, s))},
        "observation": {"source": s, "capture_time": known({"us": 1}, "measured", s) if version == 3 else unknown(), "detector_confidence": unknown(lost, s), "geometry_uncertainty": unknown(lost, s)},
    }
    if version == 3:
        out["observation"] |= {"views": {"keyframes": 3, "positions": 2}, "association": {"status": "multi_position", "may_duplicate": []}}
    return out


def scene(rng, n, version):
    profile = "perceived" if version == 3 else rng.choice(["annotated", "restricted"])
    kinds = {"d": "dataset", "q": "prior_table", "p": "profile", "c": "sensor_capture"}
    frame = {"frame_id": "scene", "conversion": {"source_id": "c" if version == 3 else "d", "source_frame_id": "scene"}} if version > 1 else {"frame_id": "scene", "conversion": "none"}
    return {
        "schema_version": version, "record_type": "scene", "scene_id": f"s{n % 5}", "scene_revision": rng.choice([0, 0, 1]), "evidence_profile": profile, "category_map": rng.choice(["m0", "m0", "m9"]), "coordinate_frame": frame,
        "sources": [{"source_id": k, "kind": v} for k, v in kinds.items()], "assumptions": [{"assumption_id": "a1"}], "objects": [thing(rng, i, version, profile) for i in range(rng.randrange(1, 4))],
    }


def command(rng, n):
    version = rng.choice([1, 1, 2])
    kind = rng.choice(["authored", "dataset_camera", "none"])
    s = "f" if kind == "authored" else "d"
    part = lambda v, **more: unknown() if kind == "none" else known(v, "annotated", s, **more)
    pose = {"pose_kind": kind, "frame_id": "scene", "scene_revision": 0, "position_m": part([0.0] * 3), "rotation_xyzw": part([0.0, 0.0, 0.0, 1.0], support="full"), "heading_xy": part([1.0, 0.0], heading_source="authored" if kind == "authored" else "camera_yaw"), "snapshot_time": unknown("not_in_source", "u" if version == 2 else "d")}
    return {"schema_version": version, "record_type": "command_context", "command_id": f"k{n}", "scene_id": f"s{n % 6}", "scene_revision": 0, "sources": [{"source_id": "f", "kind": "fixture"}, {"source_id": "d", "kind": "dataset"}, {"source_id": "u", "kind": "user_input"}], "assumptions": [], "user_pose": pose}


def map_(n):
    return {"schema_version": 1, "record_type": "category_map", "map_id": f"m{n}", "model_vocabulary": list(WORDS), "entries": [{"source_label": w, "standard": w, "model": w} for w in WORDS]}


def spoiled(rng, record):
    """A record with a few values at random places replaced by others that the format knows."""
    record = copy.deepcopy(record)
    places = []

    def walk(x):
        for k, v in x.items() if isinstance(x, dict) else enumerate(x):
            if isinstance(v, (dict, list)):
                walk(v)
            else:
                places.append((x, k))

    walk(record)
    other = {
        "source_id": ["d", "q", "c", "nobody"], "source": ["d", "q", "p", "c", "nobody"], "kind": ["annotated", "inferred", "assumed", "measured", "dataset", "prior_table", "sensor_capture", "fixture", "profile"], "reason": ["not_in_source", "withheld_by_profile", "no_permitted_prior", "not_estimated"],
        "support": ["full", "yaw_only", "axis_aligned"], "evidence_profile": ["annotated", "restricted", "perceived"], "object_id": ["o0", "o1"], "source_frame_id": ["other"], "heading_source": ["authored", "camera_yaw"], "pose_kind": ["quest_head", "none", "authored"], "scene_revision": [0, 1],
        "status": ["multi_position", "single_position", "possible_duplicate"], "keyframes": [1, 5], "positions": [1, 2, 9], "model": ["table", "lamp"], "source_label": ["chair", "odd"], "standard": ["chair"], "frame_id": ["scene", "room"], "assumption_id": ["a1", "a2"], "schema_version": [1, 2, 3, 9], "category_map": ["m0", "m9"], "record_type": ["thing"],
    }
    for x, k in rng.sample(places, min(len(places), 4)):
        if isinstance(k, int) and isinstance(x[k], float):
            x[k] = rng.choice([0.0, 1.0, 0.5])
        elif k in other and not (k == "schema_version" and record.get("evidence_profile") == "perceived"):
            x[k] = rng.choice(other[k])
    for o in record.get("objects", []):
        if "association" in o["observation"] and rng.random() < 0.3:
            o["observation"]["association"]["may_duplicate"] = rng.sample(["o0", "o1", "o2", "o7"], rng.randrange(3))
    return record


def broken(record):
    """(path, code) of all rules that one record breaks."""
    out, kind, version = [], record["record_type"], record["schema_version"]
    add = lambda *x: out.append(x)
    if (kind, version) not in contract.FORMATS or ((kind, version) == ("command_context", 2) and not any(s["kind"] == "user_input" for s in record["sources"])):
        return [("$", "E_RECORD_TYPE")]
    sources, assumed = {}, set()
    for i, s in enumerate(record.get("sources", [])):
        if s["source_id"] in sources:
            add(f"$.sources[{i}].source_id", "E_DUPLICATE_REGISTRY")
        sources.setdefault(s["source_id"], s["kind"])
    for i, a in enumerate(record.get("assumptions", [])):
        if a["assumption_id"] in assumed:
            add(f"$.assumptions[{i}].assumption_id", "E_DUPLICATE_REGISTRY")
        assumed.add(a["assumption_id"])
    known_table = contract.KNOWN_V3 if (kind, version) == ("scene", 3) else contract.KNOWN
    unknown_table = contract.UNKNOWN_TYPED if (kind, version) == ("command_context", 2) else contract.UNKNOWN

    def value(path, w, field, provenance=True):
        is_known = w["state"] == "known"
        name = w["evidence"]["source"] if is_known else w["source"]
        of = sources.get(name)
        if is_known:
            for j, a in enumerate(w["evidence"]["assumptions"]):
                if a not in assumed:
                    add(f"{path}.evidence.assumptions[{j}]", "E_UNRESOLVED_ASSUMPTION")
        if of is None:
            add(path + (".evidence.source" if is_known else ".source"), "E_UNRESOLVED_SOURCE")
        elif is_known and provenance and of not in known_table.get(w["evidence"]["kind"], ()):
            add(path + ".evidence", "E_EVIDENCE_SOURCE")
        elif not is_known and unknown_table[w["reason"]] is not None and of not in unknown_table[w["reason"]]:
            add(path + ".source", "E_EVIDENCE_SOURCE")
        if is_known and field == "rotation":
            q = w["value"]
            if abs(math.hypot(*q) - 1) > 1e-6:
                add(path + ".value", "E_QUAT_NORM")
            elif w["support"] == "yaw_only" and any(q[:2]):
                add(path + ".value", "E_QUAT_YAW_TILT")
            elif w["support"] == "axis_aligned" and (any(q[:3]) or abs(q[3]) != 1):
                add(path + ".value", "E_QUAT_AXIS_ALIGNED")
        if is_known and field == "unit" and abs(math.hypot(*w["value"]) - 1) > 1e-6:
            add(path + ".value", "E_UNIT_VECTOR")
        return of

    if kind == "category_map":
        met = set()
        for i, e in enumerate(record["entries"]):
            if e["model"] not in record["model_vocabulary"]:
                add(f"$.entries[{i}].model", "E_MAP_VOCAB")
            if e["source_label"] in met:
                add(f"$.entries[{i}].source_label", "E_MAP_DUPLICATE")
            met.add(e["source_label"])
    if kind == "command_context":
        pose = record["user_pose"]
        if pose["scene_revision"] != record["scene_revision"]:
            add("$.user_pose.scene_revision", "E_POSE_REVISION")
        if pose["pose_kind"] == "quest_head":
            add("$.user_pose.pose_kind", "E_POSE_RESERVED")
            return out
        for name, field in (("position_m", ""), ("rotation_xyzw", "rotation"), ("heading_xy", "unit"), ("snapshot_time", "")):
            w, path = pose[name], f"$.user_pose.{name}"
            of = value(path, w, field, provenance=False)
            if w["state"] != "known":
                continue
            if pose["pose_kind"] == "none":
                add(path, "E_POSE_NONE_KNOWN")
                continue
            if w["evidence"]["kind"] != "annotated" or of not in (None, contract.POSE_KIND[pose["pose_kind"]]):
                add(path + ".evidence", "E_POSE_EVIDENCE")
            if name == "heading_xy" and w["heading_source"] != contract.POSE_HEADING[pose["pose_kind"]]:
                add(path + ".heading_source", "E_HEADING_SOURCE")
    if kind != "scene":
        return out
    if version > 1:
        conversion = record["coordinate_frame"]["conversion"]
        if isinstance(conversion, dict):
            if sources.get(conversion["source_id"]) != ("dataset" if version == 2 else "sensor_capture"):
                add("$.coordinate_frame.conversion.source_id", "E_FRAME_SOURCE")
            if version == 2 and conversion["source_frame_id"] != record["coordinate_frame"]["frame_id"]:
                add("$.coordinate_frame.conversion.source_frame_id", "E_FRAME_CONVERSION")
        else:
            add("$.coordinate_frame.conversion.source_id", "E_FRAME_SOURCE")
    profile, ids = record["evidence_profile"], Counter()
    lists = {o["object_id"]: o["observation"].get("association", {}).get("may_duplicate", []) for o in record["objects"]}
    for i, o in enumerate(record["objects"]):
        base = f"$.objects[{i}]"
        if ids[o["object_id"]]:
            add(f"{base}.object_id", "E_DUPLICATE_ID")
        ids[o["object_id"]] += 1
        for path, name in ((f"{base}.source_ref.source_id", o["source_ref"]["source_id"]), (f"{base}.observation.source", o["observation"]["source"])):
            if name not in sources:
                add(path, "E_UNRESOLVED_SOURCE")
            elif sources[name] not in (("sensor_capture",) if version == 3 else ("dataset", "fixture")):
                add(path, "E_EVIDENCE_SOURCE")
        for field in contract.PERCEIVED:
            w = o
            for step in field.split("."):
                w = w[step]
            path = f"{base}.{field}"
            of = value(path, w, {"geometry.rotation_xyzw": "rotation", "semantic_front": "unit"}.get(field, ""))
            state, why, how = w["state"], w.get("reason"), w.get("evidence", {}).get("kind")
            if profile == "restricted":
                if field in ("geometry.rotation_xyzw", "semantic_front", "attributes.colours") and why != "withheld_by_profile":
                    add(path, "E_PROFILE_WITHHELD")
                if field == "geometry.size_m" and how != "assumed" and why != "no_permitted_prior":
                    add(path, "E_PROFILE_SIZE")
            elif profile == "annotated":
                if how == "assumed" or why in ("withheld_by_profile", "no_permitted_prior"):
                    add(path, "E_PROFILE_ANNOTATED")
            elif of is not None:
                allowed, reason = contract.PERCEIVED[field]
                if f"{how}:{of}" not in allowed if state == "known" else why != reason:
                    add(path, "E_PROFILE_PERCEIVED")
        if profile == "perceived" and "views" in o["observation"]:
            views, linked = o["observation"]["views"], o["observation"]["association"]
            centre, place = o["geometry"]["center_m"], f"{base}.observation"
            if views["positions"] == 1 and centre["state"] == "known" and not centre["evidence"]["assumptions"]:
                add(f"{base}.geometry.center_m.evidence.assumptions", "E_PROFILE_PERCEIVED")
            if views["positions"] > views["keyframes"]:
                add(f"{place}.views", "E_ASSOCIATION")
            if (linked["status"] == "possible_duplicate") != bool(linked["may_duplicate"]):
                add(f"{place}.association.may_duplicate", "E_ASSOCIATION")
            if (linked["status"] == "multi_position" and views["positions"] < 2) or (linked["status"] == "single_position" and views["positions"] != 1):
                add(f"{place}.association.status", "E_ASSOCIATION")
            for j, x in enumerate(linked["may_duplicate"]):
                if x == o["object_id"] or x not in lists or o["object_id"] not in lists[x]:
                    add(f"{place}.association.may_duplicate[{j}]", "E_ASSOCIATION")
    return out


def across(records):
    """Rules between records that broke none alone, by file."""
    out, first = [], {}
    for file, r in sorted(records):
        kind = r["record_type"]
        key = (kind, r["scene_id"], r["scene_revision"], r["evidence_profile"]) if kind == "scene" else (kind, r["command_id" if kind == "command_context" else "map_id"])
        if key in first:
            out.append((file, "$", "E_DUPLICATE_RECORD"))
        first.setdefault(key, (file, r))
    scenes, maps = [r for k, (_, r) in first.items() if k[0] == "scene"], {k[1]: r for k, (_, r) in first.items() if k[0] == "category_map"}
    for key, (file, r) in first.items():
        if key[0] == "command_context":
            of = [s for s in scenes if s["scene_id"] == r["scene_id"]]
            same = [s for s in of if s["scene_revision"] == r["scene_revision"]]
            if not of:
                out.append((file, "$.scene_id", "W_NOT_CROSS_CHECKED"))
            elif not same:
                out.append((file, "$.scene_revision", "E_SCENE_MISMATCH"))
            elif any(s["coordinate_frame"]["frame_id"] != r["user_pose"]["frame_id"] for s in same):
                out.append((file, "$.user_pose.frame_id", "E_FRAME_MISMATCH"))
        if key[0] == "scene":
            if r["category_map"] not in maps:
                out.append((file, "$.category_map", "W_NOT_CROSS_CHECKED"))
                continue
            entries = {(e["source_label"], e["standard"], e["model"]) for e in maps[r["category_map"]]["entries"]}
            for i, o in enumerate(r["objects"]):
                c = o["category"]
                if c["state"] == "known" and (o["source_ref"]["source_label"], c["value"]["standard"], c["value"]["model"]) not in entries:
                    out.append((file, f"$.objects[{i}].category", "E_CATEGORY_UNMAPPED"))
    return out


def test_rules_with_random_faults(spark):
    rng = random.Random(12)
    made = [scene(rng, n, 1 + n % 3) for n in range(60)] + [command(rng, n) for n in range(60)] + [map_(0), map_(1)]
    clean = [*[r for r in made if not broken(r)], command(rng, 3)]
    assert len(clean) > 100
    made += [spoiled(rng, r) for r in made for _ in range(4)]
    tilted, unnamed, posed, twice = copy.deepcopy(scene(random.Random(1), 1, 1)), scene(rng, 2, 3), command(random.Random(3), 4), map_(2)
    tilted["evidence_profile"] = "annotated"
    tilted["objects"][0]["geometry"]["rotation_xyzw"] = known([1.0, 0.0, 0.0, 0.0], support="yaw_only")
    unnamed["objects"][0]["category"]["evidence"]["assumptions"] = ["a1", "nothing"]
    posed["user_pose"] |= {"pose_kind": "none", "position_m": known([0.0] * 3)}
    twice["entries"] += [twice["entries"][1], {"source_label": "new", "standard": "new", "model": "new"}]
    other = command(rng, 77) | {"scene_revision": 5}
    other["user_pose"]["scene_revision"] = 5
    odd, lost = scene(rng, 50, 1) | {"scene_id": "s50", "scene_revision": 0, "category_map": "m0"}, command(rng, 78) | {"scene_id": "s50"}
    odd["objects"][0]["category"]["value"]["model"] = "lamp"
    lost["user_pose"]["frame_id"] = "room"
    made += [odd, lost, tilted, unnamed, posed, twice, other | {"scene_id": "s1"}]
    named = [(f"f{i:05d}", r) for i, r in enumerate(made)]
    want, sound = Counter(), []
    for file, r in named:
        found = broken(r)
        want.update((file, path, code) for path, code in found)
        if not found:
            sound.append((file, r))
    want.update(across(sound))
    documents = spark.createDataFrame([(f, json.dumps(r)) for f, r in named] + [("g1", "null"), ("g2", "[]"), ("g3", None)], "file string, document string").repartition(4)
    want.update((f, "$", "E_RECORD_TYPE") for f in ("g1", "g2", "g3"))
    got = Counter(map(tuple, contract.issues(documents).collect()))
    assert got == want, (list((got - want).items())[:5], list((want - got).items())[:5])
    codes = {code for _, _, code in want}
    assert len(codes) == 29, sorted(codes)
    assert contract.issues(documents.limit(0)).count() == 0
