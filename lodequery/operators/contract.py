"""The contract of scene, command and map records: all rules of all records at once, one issue row for each rule broken.

Records come as JSON documents that parse (``sources.strict`` gives the faults of those that do not). They are taken apart into tables of values,
objects, registries and map entries; each table's rules are a dictionary of conditions evaluated in one pass over it. Sources, assumptions, lists of
possible duplicates and maps are looked up by joins on the record, so a record's values spread over tasks. Cross-record rules follow on records that
broke none alone.

Edge cases: a record of no supported type or version is ``E_RECORD_TYPE`` and meets no further rule. Parts that are missing or of another type are null, and a rule that is
unknown is not broken. Documents that repeat are records of their own, and so duplicates of each other. An empty table gives no issues.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import read
from .evidence import KNOWN, UNKNOWN, registry
from .trees import parsed

# Fixed values of the contract: what may stand behind a value in newer formats, and in the perceived profile for each field.
TOLERANCE = 1e-6
FORMATS = {("scene", 1), ("scene", 2), ("scene", 3), ("command_context", 1), ("command_context", 2), ("category_map", 1)}
KNOWN_V3 = KNOWN | {"inferred": (*KNOWN["inferred"], "sensor_capture"), "measured": ("sensor_capture",)}
UNKNOWN_TYPED = UNKNOWN | {"not_in_source": (*UNKNOWN["not_in_source"], "user_input")}
SEEN = ("inferred:sensor_capture",)
PERCEIVED = {
    "category": (SEEN, "not_estimated"), "geometry.center_m": (SEEN, "not_estimated"), "geometry.size_m": (("assumed:prior_table", *SEEN), "no_permitted_prior"), "geometry.rotation_xyzw": (SEEN, "not_estimated"),
    "semantic_front": ((), "not_estimated"), "attributes.colours": (SEEN, "not_estimated"), "observation.capture_time": (("measured:sensor_capture",), "not_estimated"),
    "observation.detector_confidence": (SEEN, "not_estimated"), "observation.geometry_uncertainty": ((), "not_estimated"),
}
POSE = ("position_m", "rotation_xyzw", "heading_xy", "snapshot_time")
POSE_KIND = {"authored": "fixture", "dataset_camera": "dataset", "dataset_viewpoint": "dataset"}
POSE_HEADING = {"authored": "authored", "dataset_camera": "camera_yaw", "dataset_viewpoint": "camera_yaw"}

SOURCE = "array<struct<source_id: string, kind: string>>"
OBJECT = "array<struct<object_id: string, source_ref: struct<source_id: string, source_label: string>, observation: struct<source: string, views: struct<keyframes: bigint, positions: bigint>, association: struct<status: string, may_duplicate: array<string>>>>>"


def records(documents: DataFrame) -> DataFrame:
    """``documents`` (file, document) with a key ``record``, the variant ``v``, and what names a record; ``supported`` is whether its type and version are."""
    read_ = documents.select("file", parsed(F.col("document")).alias("v")).withColumn("record", F.monotonically_increasing_id())
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    kind, version = get("$.record_type", "string"), F.when(F.schema_of_variant(F.try_variant_get("v", "$.schema_version", "variant")) == "BIGINT", get("$.schema_version", "int"))
    typed = F.exists(F.coalesce(get("$.sources", SOURCE), F.array().cast(SOURCE)), lambda s: s["kind"] == "user_input")
    format_ = F.concat_ws("/", kind, version.cast("string"))
    supported = format_.isin(*[f"{a}/{b}" for a, b in sorted(FORMATS)]) & ((format_ != "command_context/2") | typed)
    return read_.select(
        "file", "record", "v", kind.alias("type"), version.alias("version"), F.coalesce(supported, F.lit(False)).alias("supported"), get("$.evidence_profile", "string").alias("profile"),
        get("$.scene_id", "string").alias("scene_id"), get("$.scene_revision", "bigint").alias("revision"), get("$.user_pose.pose_kind", "string").alias("pose_kind"),
    )


def _rows(df: DataFrame, keys: list[str], path: Column, rules: dict[str, Column], places: dict[str, Column] | None = None) -> DataFrame:
    """(keys, path, code) for each rule that holds; a rule's path may be its own."""
    found = F.array_compact(F.array(*[F.when(rule, F.struct((places or {}).get(code.split("#")[0], path).alias("path"), F.lit(code.split("#")[0]).alias("code"))) for code, rule in rules.items()]))
    return df.select(*keys, F.explode(found).alias("_i")).select(*keys, "_i.path", "_i.code")


def values(good: DataFrame) -> DataFrame:
    """(record, type, version, profile, pose_kind, path, field, state, evidence, reason, source, assumptions, numbers, support, heading_source) of all wrapped values."""
    get = lambda x, path, kind: F.try_variant_get(x, path, kind)
    keys = ["record", "type", "version", "profile", "pose_kind"]
    objects = good.filter("type = 'scene'").select(*keys, F.posexplode(get("v", "$.objects", "array<variant>")).alias("i", "o"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), get("o", f"$.{f}", "variant").alias("w")) for f in PERCEIVED])
    of_objects = objects.select(*keys, "i", F.explode(fields).alias("f")).select(*keys, F.concat(F.lit("$.objects["), "i", F.lit("]."), "f.field").alias("path"), "f.field", "f.w")
    poses = F.array(*[F.struct(F.lit(f).alias("field"), get("v", f"$.user_pose.{f}", "variant").alias("w")) for f in POSE])
    of_poses = good.filter("type = 'command_context'").select(*keys, F.explode(poses).alias("f")).select(*keys, F.concat(F.lit("$.user_pose."), "f.field").alias("path"), "f.field", "f.w")
    state = get("w", "$.state", "string")
    source = F.when(state == "known", get("w", "$.evidence.source", "string")).otherwise(get("w", "$.source", "string"))
    return of_objects.unionByName(of_poses).select(
        *keys, "path", "field", state.alias("state"), get("w", "$.evidence.kind", "string").alias("evidence"), get("w", "$.reason", "string").alias("reason"), source.alias("source"),
        get("w", "$.evidence.assumptions", "array<string>").alias("assumptions"), get("w", "$.value", "array<double>").alias("numbers"), get("w", "$.support", "string").alias("support"), get("w", "$.heading_source", "string").alias("heading_source"),
    )


def _permits(known: dict, unknown: dict) -> Column:
    """Whether a source's kind permits the evidence or the reason of a value."""
    out = F.lit(False)
    for table, state, column in ((known, "known", "evidence"), (unknown, "unknown", "reason")):
        for name, allowed in table.items():
            out = F.when((F.col("state") == state) & (F.col(column) == name), F.lit(True) if allowed is None else F.col("kind").isin(*allowed) if allowed else F.lit(False)).otherwise(out)
    return out


def value_rules() -> tuple[dict[str, Column], dict[str, Column]]:
    """The rules of a value whose source's kind is known as ``kind``, and the paths of those that name a part of it."""
    known, unknown = F.col("state") == "known", F.col("state") == "unknown"
    pose, scene = F.col("type") == "command_context", F.col("type") == "scene"
    reserved, posed = F.col("pose_kind") == "quest_head", F.col("pose_kind") != "none"
    norm = F.sqrt(F.aggregate("numbers", F.lit(0.0), lambda s, x: s + x * x))
    q = lambda i: F.abs(F.col("numbers")[i])
    off = F.abs(norm - 1) > TOLERANCE
    turned = known & (F.col("field") == "rotation_xyzw") | known & (F.col("field") == "geometry.rotation_xyzw")
    fine = _permits(KNOWN, UNKNOWN)
    fine = F.when(scene & (F.col("version") == 3), _permits(KNOWN_V3, UNKNOWN)).when(pose & (F.col("version") == 2), _permits(KNOWN, UNKNOWN_TYPED)).otherwise(fine)
    wanted_kind = reduce(lambda out, x: F.when(F.col("pose_kind") == x[0], x[1]).otherwise(out), POSE_KIND.items(), F.lit(None).cast("string"))
    wanted_heading = reduce(lambda out, x: F.when(F.col("pose_kind") == x[0], x[1]).otherwise(out), POSE_HEADING.items(), F.lit(None).cast("string"))
    profile = lambda name: scene & (F.col("profile") == name)
    withheld = F.col("field").isin("geometry.rotation_xyzw", "semantic_front", "attributes.colours")
    allowed, reason = F.lit(False), F.lit(None).cast("string")
    for field, (pairs, why) in PERCEIVED.items():
        here = F.col("field") == field
        allowed = F.when(here, F.concat_ws(":", "evidence", "kind").isin(*pairs) if pairs else F.lit(False)).otherwise(allowed)
        reason = F.when(here, why).otherwise(reason)
    none = F.coalesce(reserved & pose, F.lit(False))  # a reserved pose meets no rule of its values
    rules = {
        "E_UNRESOLVED_SOURCE": ~none & F.col("source").isNotNull() & F.col("kind").isNull(),
        "E_EVIDENCE_SOURCE": ~none & F.col("kind").isNotNull() & ~fine & (scene | unknown),
        "E_QUAT_NORM": ~none & turned & off,
        "E_QUAT_YAW_TILT": ~none & turned & ~off & (F.col("support") == "yaw_only") & (F.greatest(q(0), q(1)) > TOLERANCE),
        "E_QUAT_AXIS_ALIGNED": ~none & turned & ~off & (F.col("support") == "axis_aligned") & ((F.greatest(q(0), q(1), q(2)) > TOLERANCE) | (F.abs(q(3) - 1) > TOLERANCE)),
        "E_UNIT_VECTOR": ~none & known & F.col("field").isin("semantic_front", "heading_xy") & off,
        "E_PROFILE_WITHHELD": profile("restricted") & withheld & ~(unknown & (F.col("reason") == "withheld_by_profile")),
        "E_PROFILE_SIZE": profile("restricted") & (F.col("field") == "geometry.size_m") & ~((known & (F.col("evidence") == "assumed")) | (unknown & (F.col("reason") == "no_permitted_prior"))),
        "E_PROFILE_ANNOTATED": profile("annotated") & ((known & (F.col("evidence") == "assumed")) | (unknown & F.col("reason").isin("withheld_by_profile", "no_permitted_prior"))),
        "E_PROFILE_PERCEIVED": profile("perceived") & F.col("kind").isNotNull() & ((known & ~allowed) | (unknown & (F.col("reason") != reason))),
        "E_POSE_NONE_KNOWN": pose & known & (F.col("pose_kind") == "none"),
        "E_POSE_EVIDENCE": pose & known & posed & ~reserved & ((F.col("evidence") != "annotated") | (F.col("kind").isNotNull() & (F.col("kind") != wanted_kind))),
        "E_HEADING_SOURCE": pose & known & posed & ~reserved & (F.col("field") == "heading_xy") & (F.col("heading_source") != wanted_heading),
    }
    at = lambda end: F.concat("path", F.lit(end))
    named = F.when(known, at(".evidence.source")).otherwise(at(".source"))
    judged = F.when(known, at(".evidence")).otherwise(at(".source"))
    value = at(".value")
    places = {"E_UNRESOLVED_SOURCE": named, "E_EVIDENCE_SOURCE": judged, "E_POSE_EVIDENCE": at(".evidence"), "E_HEADING_SOURCE": at(".heading_source")}
    return rules, places | {c: value for c in ("E_QUAT_NORM", "E_QUAT_YAW_TILT", "E_QUAT_AXIS_ALIGNED", "E_UNIT_VECTOR")}


def value_issues(good: DataFrame, kinds: DataFrame, assumed: DataFrame) -> DataFrame:
    whole = values(good)
    rules, places = value_rules()
    out = _rows(whole.join(kinds, ["record", "source"], "left"), ["record"], F.col("path"), rules, places)
    used = whole.filter("state = 'known' and not (type = 'command_context' and pose_kind <=> 'quest_head')").select("record", "path", F.posexplode("assumptions").alias("j", "assumption"))
    loose = used.join(assumed, ["record", "assumption"], "left_anti")
    return out.unionByName(loose.select("record", F.concat("path", F.lit(".evidence.assumptions["), "j", F.lit("]")).alias("path"), F.lit("E_UNRESOLVED_ASSUMPTION").alias("code")))


def object_issues(good: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rules of objects: ids, the sources they come from, views and possible duplicates."""
    get = lambda x, path, kind: F.try_variant_get(x, path, kind)
    one = good.filter("type = 'scene'").select("record", "version", "profile", get("v", "$.objects", OBJECT).alias("os"), get("v", "$.objects", "array<variant>").alias("vs")).select("record", "version", "profile", F.posexplode(F.arrays_zip("os", "vs")).alias("i", "x"))
    centre = lambda path, kind: get("x.vs", f"$.geometry.center_m.{path}", kind)
    objects = one.select("record", "version", "profile", "i", F.col("x.os").alias("o"), (centre("state", "string") == "known").alias("placed"), F.size(centre("evidence.assumptions", "array<string>")).alias("n_assumed"), F.concat(F.lit("$.objects["), "i", F.lit("]")).alias("path"))
    twice = F.row_number().over(Window.partitionBy("record", "o.object_id").orderBy("i")) > 1
    views, linked = F.col("o.observation.views"), F.col("o.observation.association")
    dup, perceived = F.coalesce(F.size(linked["may_duplicate"]), F.lit(0)) > 0, F.col("profile") == "perceived"
    status, places_ = linked["status"], views["positions"]
    at = lambda end: F.concat("path", F.lit(end))
    simple = {
        "E_DUPLICATE_ID": F.col("twice"),
        "E_PROFILE_PERCEIVED": perceived & (places_ == 1) & F.col("placed") & (F.col("n_assumed") == 0),
        "E_ASSOCIATION": perceived & (places_ > views["keyframes"]),
        "E_ASSOCIATION#listed": perceived & ((status == "possible_duplicate") != dup),
        "E_ASSOCIATION#status": perceived & (((status == "multi_position") & (places_ < 2)) | ((status == "single_position") & (places_ != 1))),
    }
    counted = objects.withColumn("twice", twice)
    out = None
    for code, end in (("E_DUPLICATE_ID", ".object_id"), ("E_PROFILE_PERCEIVED", ".geometry.center_m.evidence.assumptions"), ("E_ASSOCIATION", ".observation.views"), ("E_ASSOCIATION#listed", ".observation.association.may_duplicate"), ("E_ASSOCIATION#status", ".observation.association.status")):
        some = _rows(counted, ["record"], at(end), {code: simple[code]})
        out = some if out is None else out.unionByName(some)
    ends = F.array(F.struct(F.lit(".source_ref.source_id").alias("end"), F.col("o.source_ref.source_id").alias("source")), F.struct(F.lit(".observation.source").alias("end"), F.col("o.observation.source").alias("source")))
    named = objects.select("record", "version", "path", F.explode(ends).alias("e")).select("record", "version", F.concat("path", "e.end").alias("path"), "e.source").join(kinds, ["record", "source"], "left")
    right = F.when(F.col("version") == 3, F.col("kind") == "sensor_capture").otherwise(F.col("kind").isin("dataset", "fixture"))
    out = out.unionByName(_rows(named, ["record"], F.col("path"), {"E_UNRESOLVED_SOURCE": F.col("source").isNotNull() & F.col("kind").isNull(), "E_EVIDENCE_SOURCE": ~right}))
    # the last object of an id decides what that id lists
    lists = objects.groupBy("record", F.col("o.object_id").alias("other")).agg(F.coalesce(F.max_by(linked["may_duplicate"], "i"), F.array().cast("array<string>")).alias("back"))
    told = objects.filter(perceived).select("record", F.col("o.object_id").alias("own"), "path", F.posexplode(linked["may_duplicate"]).alias("j", "other")).join(lists, ["record", "other"], "left")
    wrong = (F.col("other") == F.col("own")) | F.col("back").isNull() | ~F.array_contains("back", F.col("own"))
    return out.unionByName(_rows(told, ["record"], F.concat("path", F.lit(".observation.association.may_duplicate["), "j", F.lit("]")), {"E_ASSOCIATION": F.coalesce(wrong, F.lit(False))}))


def record_issues(good: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rules of records as wholes: frames, poses and maps."""
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    frames = good.filter("type = 'scene' and version in (2, 3)").select("record", "version", get("$.coordinate_frame.conversion.source_id", "string").alias("source"), get("$.coordinate_frame.conversion.source_frame_id", "string").alias("from"), get("$.coordinate_frame.frame_id", "string").alias("frame"))
    conversion = "$.coordinate_frame.conversion."
    framed = frames.join(kinds, ["record", "source"], "left")
    right = F.when(F.col("version") == 2, F.col("kind") == "dataset").otherwise(F.col("kind") == "sensor_capture")
    out = _rows(framed, ["record"], F.lit(conversion + "source_id"), {"E_FRAME_SOURCE": ~F.coalesce(right, F.lit(False)), "E_FRAME_CONVERSION": (F.col("version") == 2) & (F.col("from") != F.col("frame"))}, {"E_FRAME_CONVERSION": F.lit(conversion + "source_frame_id")})
    poses = good.filter("type = 'command_context'")
    out = out.unionByName(_rows(poses, ["record"], F.lit("$.user_pose.pose_kind"), {"E_POSE_RESERVED": F.col("pose_kind") == "quest_head", "E_POSE_REVISION": get("$.user_pose.scene_revision", "bigint") != F.col("revision")}, {"E_POSE_REVISION": F.lit("$.user_pose.scene_revision")}))
    entries = map_entries(good).withColumn("twice", F.row_number().over(Window.partitionBy("record", "source_label").orderBy("i")) > 1)
    at = lambda end: F.concat(F.lit("$.entries["), "i", F.lit(f"].{end}"))
    return out.unionByName(_rows(entries, ["record"], at("model"), {"E_MAP_VOCAB": ~F.array_contains("vocabulary", F.col("model")), "E_MAP_DUPLICATE": F.col("twice")}, {"E_MAP_DUPLICATE": at("source_label")}))


def map_entries(good: DataFrame) -> DataFrame:
    maps = good.filter("type = 'category_map'").select("record", F.try_variant_get("v", "$.map_id", "string").alias("map_id"), F.try_variant_get("v", "$.model_vocabulary", "array<string>").alias("vocabulary"), F.posexplode(F.try_variant_get("v", "$.entries", "array<struct<source_label: string, standard: string, model: string>>")).alias("i", "e"))
    return maps.select("record", "map_id", "vocabulary", "i", "e.*")


def cross_issues(sound: DataFrame) -> DataFrame:
    """Rules between records: identities, a command's scene and frame, an object's category in its scene's map. The first record of an identity, by file, counts."""
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    identity = F.when(F.col("type") == "scene", F.to_json(F.struct("scene_id", "revision", "profile"))).when(F.col("type") == "command_context", get("$.command_id", "string")).otherwise(get("$.map_id", "string"))
    numbered = sound.withColumn("_n", F.row_number().over(Window.partitionBy("type", identity).orderBy("file", "record")))
    out = numbered.filter("_n > 1").select("record", F.lit("$").alias("path"), F.lit("E_DUPLICATE_RECORD").alias("code"))
    first = numbered.filter("_n = 1")
    frame = lambda path, name: get(path, "string").alias(name)
    scenes = first.filter("type = 'scene'").select("scene_id", F.col("revision").alias("held"), frame("$.coordinate_frame.frame_id", "frame"))
    known = scenes.groupBy("scene_id").agg(F.collect_set(F.struct("held", "frame")).alias("_held"))  # the revisions of one scene
    commands = first.filter("type = 'command_context'").select("record", "scene_id", "revision", frame("$.user_pose.frame_id", "own")).join(known, "scene_id", "left")
    same = F.filter("_held", lambda x: x["held"] == F.col("revision"))
    rules = {"W_NOT_CROSS_CHECKED": F.col("_held").isNull(), "E_SCENE_MISMATCH": F.size(same) == 0, "E_FRAME_MISMATCH": F.exists(same, lambda x: x["frame"] != F.col("own"))}
    places = {"E_SCENE_MISMATCH": F.lit("$.scene_revision"), "E_FRAME_MISMATCH": F.lit("$.user_pose.frame_id")}
    out = out.unionByName(_rows(commands, ["record"], F.lit("$.scene_id"), rules, places))
    maps = first.filter("type = 'category_map'")
    named = first.filter("type = 'scene'").select("record", "v", get("$.category_map", "string").alias("map_id"))
    given = maps.select(get("$.map_id", "string").alias("map_id"), F.lit(True).alias("given"))
    joined = named.join(given, "map_id", "left")
    out = out.unionByName(joined.filter("given is null").select("record", F.lit("$.category_map").alias("path"), F.lit("W_NOT_CROSS_CHECKED").alias("code")))
    category = "array<struct<source_ref: struct<source_label: string>, category: struct<state: string, value: struct<standard: string, model: string>>>>"
    objects = joined.filter("given").select("record", "map_id", F.posexplode(get("$.objects", category)).alias("i", "o")).filter("o.category.state = 'known'")
    told = objects.select("record", "i", "map_id", F.col("o.source_ref.source_label").alias("source_label"), F.col("o.category.value.standard").alias("standard"), F.col("o.category.value.model").alias("model"))
    unmapped = told.join(map_entries(maps).select("map_id", "source_label", "standard", "model").distinct(), ["map_id", "source_label", "standard", "model"], "left_anti")
    return out.unionByName(unmapped.select("record", F.concat(F.lit("$.objects["), "i", F.lit("].category")).alias("path"), F.lit("E_CATEGORY_UNMAPPED").alias("code")))


def issues(documents: DataFrame) -> DataFrame:
    """(file, path, code) of every rule broken by the documents (file, document), alone or with each other."""
    from .clusters import cut

    every = cut(records(documents))
    good = every.filter("supported")
    list_ = lambda path, kind: good.select("record", F.posexplode(F.try_variant_get("v", path, kind)).alias("place", "e")).select("record", "place", "e.*")
    sources = list_("$.sources", SOURCE).withColumnRenamed("source_id", "source")
    assumptions = list_("$.assumptions", "array<struct<assumption_id: string>>").withColumnRenamed("assumption_id", "assumption")
    kinds, _ = registry(sources, ["record", "source"], "place", "kind")
    assumed, _ = registry(assumptions.withColumn("one", F.lit(1)), ["record", "assumption"], "place", "one")
    repeats = None
    for entries, name, column in ((sources, "sources", "source"), (assumptions, "assumptions", "assumption")):
        again = entries.withColumn("_n", F.row_number().over(Window.partitionBy("record", column).orderBy("place"))).filter("_n > 1")
        some = again.select("record", F.concat(F.lit(f"$.{name}["), "place", F.lit(f"].{column}_id")).alias("path"), F.lit("E_DUPLICATE_REGISTRY").alias("code"))
        repeats = some if repeats is None else repeats.unionByName(some)
    alone = [every.filter(~F.col("supported")).select("record", F.lit("$").alias("path"), F.lit("E_RECORD_TYPE").alias("code")), repeats, value_issues(good, kinds, assumed), object_issues(good, kinds), record_issues(good, kinds)]
    single = cut(reduce(DataFrame.unionByName, alone))
    sound = good.join(single.select("record").distinct(), "record", "left_anti")
    return single.unionByName(cross_issues(sound)).join(every.select("record", "file"), "record").select("file", "path", "code")


def scene_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as scene records of up to 20 objects, orders' customers as commands about them, and one map: what the data make wrong stays wrong."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    evidence = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit("s").alias("source"), F.array().cast("array<string>").alias("assumptions"))
    known = lambda value, **more: F.struct(F.lit("known").alias("state"), value.alias("value"), *[c.alias(n) for n, c in more.items()], evidence("annotated").alias("evidence"))
    absent = F.struct(F.lit("unknown").alias("state"), F.lit("not_in_source").alias("reason"), F.lit("s").alias("source"))
    label = F.element_at(F.array(*map(F.lit, ("table", "chair", "box", "lamp"))), (F.floor(F.abs(e(20)) * 10) % 4 + 1).cast("int"))
    norm = F.hypot(e(7), e(8))
    front = F.when(F.abs(e(9)) > 0.02, F.array(e(7) / norm, e(8) / norm)).otherwise(F.array(e(7), e(8)))
    turn = F.when(e(10) > 0, F.array(F.lit(0.0), F.lit(0.0), e(11), F.sqrt(1 - e(11) * e(11)))).otherwise(F.array(e(12), F.lit(0.0), F.lit(0.0), F.sqrt(1 - e(12) * e(12))))
    thing = F.struct(
        F.format_string("obj_%03d", F.least(F.col("vec_id") % 20, F.lit(18)).cast("int")).alias("object_id"), F.struct(F.lit("s").alias("source_id"), label.alias("source_label")).alias("source_ref"),
        known(F.struct(label.alias("standard"), F.when(e(13) > 0.2, "other").otherwise(label).alias("model"))).alias("category"),
        F.struct(known(F.array(e(1), e(2), e(3))).alias("center_m"), known(F.array(*[F.abs(e(i)) for i in (4, 5, 6)])).alias("size_m"), known(turn, support=F.lit("yaw_only")).alias("rotation_xyzw")).alias("geometry"),
        known(front).alias("semantic_front"), F.struct(absent.alias("colours")).alias("attributes"),
        F.struct(F.lit("s").alias("source"), absent.alias("capture_time"), absent.alias("detector_confidence"), absent.alias("geometry_uncertainty")).alias("observation"),
    )
    blocks = read(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 20).alias("block")).agg(F.max("label").alias("kind"), F.transform(F.sort_array(F.collect_list(F.struct("vec_id", thing.alias("o")))), lambda x: x["o"]).alias("objects"))
    kind = F.when(F.col("kind") == 9, "prior_table").otherwise("dataset")
    sources = lambda k: F.array(F.struct(F.lit("s").alias("source_id"), k.alias("kind"))).alias("sources")
    scene = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("scene").alias("record_type"), F.concat(F.lit("scene_"), "block").alias("scene_id"), F.lit(0).alias("scene_revision"), F.lit("annotated").alias("evidence_profile"), F.lit("map").alias("category_map"), F.struct(F.lit("scene").alias("frame_id")).alias("coordinate_frame"), sources(kind), F.array().cast("array<struct<assumption_id: string>>").alias("assumptions"), "objects"))
    scenes = blocks.select(F.concat(F.lit("scene_"), "block").alias("file"), scene.alias("document"))
    heading = F.struct(F.lit("known").alias("state"), F.array(F.lit(0.6), F.lit(0.8)).alias("value"), F.when(F.col("o_orderstatus") == "P", "camera_yaw").otherwise("authored").alias("heading_source"), evidence("annotated").alias("evidence"))
    pose = F.struct(F.when(F.col("o_orderpriority").startswith("5"), "quest_head").otherwise("authored").alias("pose_kind"), F.lit("scene").alias("frame_id"), F.when(F.col("o_totalprice") > 400_000, 1).otherwise(0).alias("scene_revision"), absent.alias("position_m"), absent.alias("rotation_xyzw"), heading.alias("heading_xy"), absent.alias("snapshot_time"))
    command = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("command_context").alias("record_type"), F.concat(F.lit("c"), "o_orderkey").alias("command_id"), F.concat(F.lit("scene_"), F.floor(F.col("o_custkey") / 2)).alias("scene_id"), F.lit(0).alias("scene_revision"), sources(F.lit("fixture")), pose.alias("user_pose")))
    commands = read(spark, sf_dir, "orders").select(F.concat(F.lit("command_"), "o_orderkey").alias("file"), command.alias("document"))
    entry = lambda x: F.struct(F.lit(x).alias("source_label"), F.lit(x).alias("standard"), F.lit(x).alias("model"))
    map_ = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("category_map").alias("record_type"), F.lit("map").alias("map_id"), F.array(*map(F.lit, ("table", "chair", "box", "lamp"))).alias("model_vocabulary"), F.array(*map(entry, ("table", "chair", "box", "lamp"))).alias("entries")))
    return scenes.unionByName(commands).unionByName(spark.range(1).select(F.lit("map").alias("file"), map_.alias("document")))


def q_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(scene_documents(spark, sf_dir))


QUERIES = {"contract_records": q_contract}
SQL: dict[str, str] = {}
