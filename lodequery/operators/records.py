"""Records: subscenes that are complete for some categories, guards and reason codes, rechecks of stored decisions, conversion and keys.

Work on one record is a column expression; what belongs to several records is one aggregate or an equi-join on their key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import OBJECTS, objects, read
from .ranking import SQL as RANK_SQL
from .ranking import q_rank

# The objects a prompt can hold, the share of a plausible choice, the largest distance of two share vectors.
OBJECT_LIMIT, PLAUSIBLE, MOST_DISTANCE, TOLERANCE = 10, 0.01, 0.05, 1e-6
#: The categories that each command needs; the last one was not parsed.
NEEDS = (("one", ("chair",)), ("two", ("chair", "table")), ("three", ("box", "lamp")), ("unparsed", None))
CODES = "ABCD"
#: Detail codes of the reasons a relation may give, by how the reason starts.
REASONS = (
    ("missing_centre:", "missing_centre"), ("missing_size:", "missing_size"), ("missing_rotation:", "missing_rotation"), ("missing_semantic_front:", "missing_semantic_front"),
    ("missing_user_position:", "missing_pose"), ("missing_heading:", "missing_pose"), ("degenerate_viewer_anchor", "degenerate_frame"), ("vertical_semantic_front", "degenerate_frame"),
    ("boundary:", "boundary_relation"),
)


def subscenes(things: DataFrame, commands: DataFrame, limit: int = OBJECT_LIMIT) -> DataFrame:
    """For each scene and command (command, required): the objects whose category is required or unknown, never cut.

    status is fits at or under ``limit`` objects, else over_budget; without required categories it is unassessed_parse and nothing is retained.
    """
    grouped = things.groupBy("scene_id").agg(F.collect_list(F.struct(F.col("object_id").cast("string").alias("id"), "category")).alias("objects"))
    rows = grouped.crossJoin(F.broadcast(commands))  # a few commands for each scene: the output has a row for each pair
    kept = F.filter("objects", lambda o: o["category"].isNull() | F.array_contains("required", o["category"]))
    ids = lambda c: F.array_join(F.sort_array(F.transform(c, lambda o: o["id"])), ",")
    assessed = F.col("required").isNotNull()
    status = F.when(~assessed, "unassessed_parse").when(F.size("kept") <= limit, "fits").otherwise("over_budget")
    return rows.withColumn("kept", F.when(assessed, kept)).select(
        "scene_id", "command", status.alias("status"), F.size("objects").alias("base_count"), F.when(assessed, F.size("kept")).alias("kept_count"), ids(F.col("kept")).alias("kept_ids"),
        ids(F.filter("kept", lambda o: o["category"].isNull())).alias("unknown_ids"),
        F.when(assessed, F.sha2(F.concat_ws("|", F.col("scene_id").cast("string"), "command", ids(F.col("kept"))), 256)).alias("selection_id"),
    )


def guarded(answers: DataFrame, duplicates: DataFrame, key: str = "object_ids") -> DataFrame:
    """Answers (status, target_id) made ambiguous where the target may be a duplicate; ``duplicates`` has (target_id, may_duplicate array)."""
    met = answers.join(duplicates, "target_id", "left")
    doubt = (F.col("status") == "resolved") & F.col("may_duplicate").isNotNull()
    involved = F.array_join(F.transform(F.sort_array(F.array_distinct(F.concat(F.array("target_id"), "may_duplicate"))), lambda x: x.cast("string")), ",")
    return met.select(*[c for c in answers.columns if c not in ("status", key, "target_id")], F.when(doubt, "ambiguous").otherwise(F.col("status")).alias("status"), F.when(doubt, involved).otherwise(F.col(key)).alias(key), F.when(doubt, "possible_duplicate").alias("detail"))


def reason_codes(reasons: Column) -> Column:
    """The sorted detail codes of an array of reasons; relation_unknown if none of them has one."""
    code = lambda r: reduce(lambda other, rule: F.when(r.startswith(rule[0]), rule[1]).otherwise(other), reversed(REASONS), F.lit(None).cast("string"))
    found = F.sort_array(F.array_distinct(F.array_compact(F.transform(reasons, code))))
    return F.when(F.size(found) == 0, F.array(F.lit("relation_unknown"))).otherwise(found)


def evidence_union(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, column): the sorted union of the arrays of each group."""
    return df.select(*keys, F.explode_outer(column).alias("_x")).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("_x")), ",").alias(column))


def softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    parts = [F.exp(x - top) for x in logits]
    return [p / sum(parts[1:], parts[0]) for p in parts]


def decision_problems(logits: list[Column], shares: list[Column], choice: Column, margin: Column, top_share: Column, codes: str = CODES, tolerance: float = TOLERANCE) -> Column:
    """The problems of a stored decision, in order, joined by commas: its shares, choice (an exact tie asks), margin and top share against its logits."""
    want = softmax(logits)
    best = F.greatest(*logits)
    tied = F.filter(F.array(*[F.when(x == best, F.lit(c)) for x, c in zip(logits, codes, strict=True)]), lambda c: c.isNotNull())
    decided = F.when(F.size(tied) > 1, F.lit("ask")).otherwise(F.element_at(tied, 1))
    ranked = F.sort_array(F.array(*logits), asc=False)
    checks = [
        ("shares", reduce(lambda a, b: a | b, [F.abs(s - w) > tolerance for s, w in zip(shares, want, strict=True)])),
        ("choice", ~choice.eqNullSafe(decided)),
        ("margin", margin.isNull() | (F.abs(margin - (ranked[0] - ranked[1])) > tolerance)),
        ("top_share", top_share.isNull() | (F.abs(top_share - F.greatest(*want)) > tolerance)),
    ]
    return F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks])), ",")


def compared_shares(first: list[Column], second: list[Column], codes: str = CODES) -> list[Column]:
    """same_best, plausible order of either (shares of at least PLAUSIBLE, falling, then by code), distance and passed."""

    def order(shares: list[Column]) -> Column:
        pairs = F.array(*[F.when(s >= PLAUSIBLE, F.struct((-s).alias("s"), F.lit(c).alias("c"))) for s, c in zip(shares, codes, strict=True)])
        return F.array_join(F.transform(F.sort_array(F.array_compact(pairs)), lambda p: p["c"]), "")

    best = lambda shares: F.array_min(F.array(*[F.struct((-s).alias("s"), F.lit(c).alias("c")) for s, c in zip(shares, codes, strict=True)]))["c"]
    distance = 0.5 * sum((F.abs(a - b) for a, b in zip(first, second, strict=True)), F.lit(0.0))
    same = best(first) == best(second)
    return [same.alias("same_best"), order(first).alias("first_order"), order(second).alias("second_order"), F.round(distance, 9).alias("distance"), (same & (order(first) == order(second)) & (distance <= MOST_DISTANCE)).alias("passed")]


def changed_fields(parent: DataFrame, derived: DataFrame, key: str, declared: tuple[str, ...]) -> DataFrame:
    """(key, changed): derived records that differ from their parent outside the declared fields, or have none (missing_parent)."""
    fields = [c for c in derived.columns if c != key and c not in declared]
    old = parent.select(key, F.struct(*fields).alias("_old"))
    met = derived.select(key, F.struct(*fields).alias("_new")).join(old, key, "left")
    names = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in fields])), ",")
    return met.select(key, F.when(F.col("_old").isNull(), "missing_parent").otherwise(names).alias("changed")).filter("changed <> ''")


def canonical_key(relation: Column, target: Column, anchors: Column, symmetric: tuple[str, ...]) -> Column:
    """One JSON text for a constraint; the two sides of a symmetric relation are ordered, and so are the anchors."""
    both = F.array_sort(F.concat(F.array(target), anchors))
    return F.when(relation.isin(*symmetric), F.to_json(F.struct(relation.alias("r"), both.alias("x")))).otherwise(F.to_json(F.struct(relation.alias("r"), target.alias("t"), F.array_sort(anchors).alias("x"))))


def set_differences(left: Column, right: Column) -> tuple[Column, Column, Column]:
    """(only left, only right, relation) of two arrays as sets: equal, subset, superset or neither."""
    less, more = F.array_sort(F.array_except(left, right)), F.array_sort(F.array_except(right, left))
    relation = F.when((F.size(less) == 0) & (F.size(more) == 0), "equal").when(F.size(less) == 0, "subset").when(F.size(more) == 0, "superset").otherwise("neither")
    return F.array_join(less, ","), F.array_join(more, ","), relation


def converted(lines: DataFrame, line: str = "line", leading: int = 4, width: int = 2, groups: int = 3) -> DataFrame:
    """Ragged object rows (id, label, heading and front in degrees, then groups of a colour and its share) as typed columns.

    ``_`` stands for no front and for an empty group; groups left out at the end are empty. Heading becomes a quaternion about the vertical,
    front a unit vector, colours those of the groups in order, each once. Ids are ordered as numbers.
    """
    cells = F.split(line, ",")
    at = lambda i: F.get(cells, F.lit(i))
    heading, front = F.radians(at(2).cast("double")), F.radians(F.when(at(3) != "_", at(3)).cast("double"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.get(cells, g * width + leading))
    colours = F.array_distinct(F.filter(slots, lambda c: c.isNotNull() & (c != "_")))
    return lines.select(
        at(0).cast("bigint").alias("object_id"), at(1).alias("label"),
        *[F.round(x, 9).alias(n) for n, x in (("qz", F.sin(heading / 2)), ("qw", F.cos(heading / 2)), ("fx", F.cos(front)), ("fy", F.sin(front)))],
        F.array_join(colours, ",").alias("colours"), F.try_divide(F.size(cells) - leading, F.lit(width)).cast("int").alias("groups"),
    )


#: What a cell must look like: a number, an id without leading zeros, a label of letters.
CELLS = {"number": r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?\z", "decimal_id": r"\A(0|[1-9][0-9]*)\z", "label": r"\A[A-Za-z][A-Za-z ]*\z"}


def cell_issues(df: DataFrame, keys: list[str], cells: dict[str, str]) -> DataFrame:
    """(keys, column, code): cells that are empty or not of their kind, one row for each."""
    found = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.struct(F.lit(c).alias("column"), F.lit("empty").alias("code"))).when(~F.col(c).rlike(CELLS[kind]), F.struct(F.lit(c).alias("column"), F.lit(f"not_{kind}").alias("code"))) for c, kind in cells.items()]
    return df.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("i")).select(*keys, "i.column", "i.code")


def requests(parents: DataFrame, key: str, views: tuple[str, ...], formats: tuple[str, ...]) -> DataFrame:
    """One row for each parent, view and format, with an id by content; the product is made in the row, without a join."""
    each = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(f).alias("format")) for v in views for f in formats])
    rows = parents.select(key, F.explode(each).alias("r")).select(key, "r.view", "r.format")
    return rows.withColumn("request_id", F.sha2(F.concat_ws("|", F.col(key).cast("string"), "view", "format"), 256))


def compact_columns(conditions: dict[str, Column]) -> Column:
    """The names of the columns whose condition holds, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()])), ",")


def object_ids(things: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds name: obj_001, obj_002, ... in the given order within each scene."""
    return things.withColumn("name", F.format_string("obj_%03d", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))))


def embedded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column]]:
    """A stored decision for each vector: its first four numbers are logits."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    return read(spark, sf_dir, "embeddings"), [e(i) for i in (1, 2, 3, 4)]


def q_subscenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscenes(objects(spark, sf_dir), spark.createDataFrame([(n, list(c) if c else None) for n, c in NEEDS], "command string, required array<string>"))


def q_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = q_rank(spark, sf_dir).withColumn("target_id", F.when(F.col("status") == "resolved", F.col("object_ids").cast("bigint")))
    doubtful = objects(spark, sf_dir).filter("object_id % 6 = 1").select(F.col("object_id").alias("target_id"), F.array(F.col("object_id") + 1).alias("may_duplicate"))
    return guarded(answers, doubtful)


def q_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = lambda prefix, bad: F.when(bad, F.concat(F.lit(prefix), F.col("object_id").cast("string")))
    reasons = F.array_compact(F.array(reason("missing_centre:", F.col("cx").isNull()), reason("missing_semantic_front:", F.col("fx") < 0), reason("boundary:", F.abs(F.col("fy")) < 0.2), reason("missing_heading:", F.col("category").isNull()), reason("support:", F.col("sx") > 1)))
    return objects(spark, sf_dir).select("scene_id", "object_id", F.array_join(reason_codes(reasons), ",").alias("codes"))


def q_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects(spark, sf_dir).withColumn("assumptions", F.array_compact(F.array(F.when(F.col("cx").isNull(), "centre"), F.when(F.col("fx") < 0, "front"), F.when(F.col("category").isNull(), "category"), F.col("colour"))))
    return evidence_union(rows, ["scene_id", "category"], "assumptions")


def q_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, logits = embedded(spark, sf_dir)
    shares = softmax(logits)
    stored = [F.when(F.col("vec_id") % 10 == 0, s + 0.01).otherwise(s) for s in shares]
    choice = F.when(F.col("vec_id") % 13 == 0, F.lit("A")).otherwise(F.array_min(F.array(*[F.struct((-x).alias("x"), F.lit(c).alias("c")) for x, c in zip(logits, CODES)]))["c"])
    ranked = F.sort_array(F.array(*logits), asc=False)
    margin = F.when(F.col("vec_id") % 7 != 0, ranked[0] - ranked[1])
    return rows.select("vec_id", decision_problems(logits, stored, choice, margin, F.greatest(*shares)).alias("problems"))


def q_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, logits = embedded(spark, sf_dir)
    moved = [x + F.lit(0.05 * i) for i, x in enumerate(logits)]
    return rows.select("vec_id", *compared_shares(softmax([4 * x for x in logits]), softmax([4 * x for x in moved])))


def q_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    derived = parent.withColumn("o_custkey", F.col("o_custkey") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_orderpriority"))).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 33 != 0, F.col("o_orderstatus")))
    return changed_fields(parent.filter("o_orderkey % 17 <> 0"), derived, "o_orderkey", ("o_orderpriority",))


def q_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("object_id")
    relation = F.element_at(F.array(*map(F.lit, ("near", "on", "between"))), (n % 3 + 1).cast("int"))
    return objects(spark, sf_dir).select("object_id", canonical_key(relation, n % 7, F.array(n % 5, n % 4), ("near",)).alias("key"))


def q_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = objects(spark, sf_dir).groupBy("scene_id").agg(F.collect_set(F.when(F.col("fx") > 1, F.col("category")).otherwise(F.col("colour"))).alias("left"), F.collect_set(F.when(F.col("fy") > 1, F.col("category")).otherwise(F.col("colour"))).alias("right"))
    less, more, relation = set_differences(F.col("left"), F.col("right"))
    return sets.select("scene_id", less.alias("only_left"), more.alias("only_right"), relation.alias("relation"))


def q_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("vec_id")
    group = lambda k: F.when(n % (k + 2) == 0, F.lit("_,_")).otherwise(F.concat(F.element_at(F.array(*map(F.lit, ("red", "green", "blue"))), ((n + k * (n % 2)) % 3 + 1).cast("int")), F.lit(",0.5")))
    line = F.concat_ws(",", n.cast("string"), F.concat(F.lit("label"), (n % 9).cast("string")), (n % 360).cast("string"), F.when(n % 4 == 0, "_").otherwise((n % 90).cast("string")), group(0), group(1), F.when(n % 3 != 0, group(2)))
    return converted(read(spark, sf_dir, "embeddings").select(line.alias("line")))


def q_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 3 == 0, "0").otherwise(""), F.col("o_orderkey").cast("string")).alias("clerk"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey").cast("string")).alias("customer"))
    return cell_issues(rows, ["o_orderkey"], {"clerk": "decimal_id", "priority": "label", "customer": "number"})


def q_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).select("scene_id", "object_id", compact_columns({"category": F.col("category").isNull(), "centre": F.col("cx") > 0, "size": F.col("sx") > 1, "front": F.abs(F.col("fx")) < 0.5}).alias("conditional"))


def q_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.asc_nulls_last("category"), F.col("cx").isNull(), *[F.asc_nulls_last(F.round(f"c{s}", 2)) for s in "xyz"], F.col("object_id")]
    return object_ids(objects(spark, sf_dir), ["scene_id"], order).select("scene_id", "object_id", "name")


QUERIES = {
    "subscenes": q_subscenes, "association_guard": q_guard, "reason_codes": q_reasons, "evidence_union": q_evidence, "decision_recheck": q_recheck, "compared_shares": q_compared,
    "changed_fields": q_preserved, "canonical_keys": q_keys, "set_differences": q_sets, "converted_objects": q_converted, "cell_issues": q_cells, "compact_columns": q_compact, "ordered_ids": q_ids,
    "request_product": lambda s, d: requests(read(s, d, "customer"), "c_custkey", ("full", "known"), ("coordinates", "relations")),
}

_needs = ", ".join(f"('{n}', {list(c) if c else 'NULL::VARCHAR[]'})" for n, c in NEEDS)
_logits = ", ".join(f"embedding[{i}]::DOUBLE AS x{i}" for i in (1, 2, 3, 4))
_soft = lambda xs: [f"exp({x} - greatest({', '.join(xs)})) / (" + " + ".join(f"exp({y} - greatest({', '.join(xs)}))" for y in xs) + ")" for x in xs]
_x = ["x1", "x2", "x3", "x4"]
_best = "CASE greatest(x1, x2, x3, x4) " + " ".join(f"WHEN {x} THEN '{c}'" for x, c in zip(_x, CODES)) + " END"
_order = lambda p: "array_to_string(list_transform(list_sort(list_filter([" + ", ".join(f"{{'s': -{p}{i}, 'c': '{c}'}}" for i, c in zip((1, 2, 3, 4), CODES)) + f"], lambda t: t.s <= -{PLAUSIBLE})), lambda t: t.c), '')"
_top = lambda p: f"CASE greatest({p}1, {p}2, {p}3, {p}4) " + " ".join(f"WHEN {p}{i} THEN '{c}'" for i, c in zip((1, 2, 3, 4), CODES)) + " END"
_code = "CASE " + " ".join(f"WHEN starts_with(r, '{p}') THEN '{c}'" for p, c in REASONS) + " END"
_group = lambda k: f"CASE WHEN vec_id % {k + 2} = 0 THEN '_' ELSE ['red', 'green', 'blue'][((vec_id + {k} * (vec_id % 2)) % 3 + 1)::INT] END"
SQL = {
    "subscenes": f"""
        WITH {OBJECTS}, needs(command, required) AS (VALUES {_needs}), kept AS (
            SELECT scene_id, command, required IS NOT NULL AS assessed, count(*) AS base_count, count(*) FILTER (keep) AS n,
                   array_to_string(list_sort(coalesce(list(object_id::VARCHAR) FILTER (keep), [])), ',') AS ids, array_to_string(list_sort(coalesce(list(object_id::VARCHAR) FILTER (category IS NULL), [])), ',') AS unknown
            FROM (SELECT *, category IS NULL OR list_contains(required, category) AS keep FROM objects, needs) GROUP BY ALL
        )
        SELECT scene_id, command, CASE WHEN NOT assessed THEN 'unassessed_parse' WHEN n <= {OBJECT_LIMIT} THEN 'fits' ELSE 'over_budget' END AS status, base_count, CASE WHEN assessed THEN n END AS kept_count,
               CASE WHEN assessed THEN ids END AS kept_ids, CASE WHEN assessed THEN unknown END AS unknown_ids, CASE WHEN assessed THEN sha256(concat_ws('|', scene_id, command, ids)) END AS selection_id FROM kept
    """,
    "association_guard": f"""
        WITH answers AS (FROM ({RANK_SQL['closest']})), judged AS (SELECT *, status = 'resolved' AND (CASE WHEN status = 'resolved' THEN object_ids END)::BIGINT % 6 = 1 AS doubt FROM answers)
        SELECT scene_id, anchor_id, CASE WHEN doubt THEN 'ambiguous' ELSE status END AS status, CASE WHEN doubt THEN object_ids || ',' || ((CASE WHEN doubt THEN object_ids END)::BIGINT + 1) ELSE object_ids END AS object_ids,
               CASE WHEN doubt THEN 'possible_duplicate' END AS detail FROM judged
    """,
    "reason_codes": f"""
        WITH {OBJECTS}, long AS (
            SELECT scene_id, object_id, unnest([CASE WHEN cx IS NULL THEN 'missing_centre:' END, CASE WHEN fx < 0 THEN 'missing_semantic_front:' END, CASE WHEN abs(fy) < 0.2 THEN 'boundary:' END, CASE WHEN category IS NULL THEN 'missing_heading:' END, CASE WHEN sx > 1 THEN 'support:' END]) AS r FROM objects
        ) SELECT scene_id, object_id, coalesce(string_agg(DISTINCT {_code}, ',' ORDER BY {_code}), 'relation_unknown') AS codes FROM long GROUP BY ALL
    """,
    "evidence_union": f"""
        WITH {OBJECTS}, long AS (SELECT scene_id, category, unnest([CASE WHEN cx IS NULL THEN 'centre' END, CASE WHEN fx < 0 THEN 'front' END, CASE WHEN category IS NULL THEN 'category' END, colour]) AS x FROM objects)
        SELECT scene_id, category, coalesce(string_agg(DISTINCT x, ',' ORDER BY x), '') AS assumptions FROM long GROUP BY ALL
    """,
    "decision_recheck": f"""
        WITH v AS (SELECT vec_id, {_logits} FROM embeddings), s AS (
            SELECT *, list_sort([x1, x2, x3, x4], 'DESC') AS ranked, len(list_filter([x1, x2, x3, x4], lambda x: x = greatest(x1, x2, x3, x4))) AS ties, {_best} AS best FROM v
        ) SELECT vec_id, concat_ws(',', CASE WHEN vec_id % 10 = 0 THEN 'shares' END, CASE WHEN (CASE WHEN vec_id % 13 = 0 THEN 'A' ELSE best END) <> (CASE WHEN ties > 1 THEN 'ask' ELSE best END) THEN 'choice' END, CASE WHEN vec_id % 7 = 0 THEN 'margin' END) AS problems FROM s
    """,
    "compared_shares": f"""
        WITH v AS (SELECT vec_id, {_logits} FROM embeddings), m AS (SELECT vec_id, 4 * x1 AS x1, 4 * x2 AS x2, 4 * x3 AS x3, 4 * x4 AS x4, 4 * x1 AS y1, 4 * (x2 + 0.05::DOUBLE) AS y2, 4 * (x3 + 0.1::DOUBLE) AS y3, 4 * (x4 + 0.15::DOUBLE) AS y4 FROM v),
        s AS (SELECT vec_id, {', '.join(f'{e} AS a{i}' for i, e in enumerate(_soft(_x), 1))}, {', '.join(f'{e} AS b{i}' for i, e in enumerate(_soft(['y1', 'y2', 'y3', 'y4']), 1))} FROM m),
        o AS (SELECT vec_id, {_top('a')} = {_top('b')} AS same_best, {_order('a')} AS first_order, {_order('b')} AS second_order, 0.5::DOUBLE * (abs(a1 - b1) + abs(a2 - b2) + abs(a3 - b3) + abs(a4 - b4)) AS d FROM s)
        SELECT vec_id, same_best, first_order, second_order, round(d, 9) AS distance, same_best AND first_order = second_order AND d <= {MOST_DISTANCE} AS passed FROM o
    """,
    "changed_fields": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'missing_parent' ELSE concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'o_custkey' END, CASE WHEN o_orderkey % 33 = 0 THEN 'o_orderstatus' END) END AS changed
        FROM orders WHERE o_orderkey % 17 = 0 OR o_orderkey % 11 = 0
    """,
    "canonical_keys": f"""
        WITH {OBJECTS}, c AS (SELECT object_id, object_id % 3 AS r, object_id % 7 AS t, object_id % 5 AS a, object_id % 4 AS b FROM objects)
        SELECT object_id, CASE WHEN r = 0 THEN '{{"r":"near","x":[' || array_to_string(list_sort([t, a, b]), ',') || ']}}' ELSE '{{"r":"' || ['on', 'between'][r::INT] || '","t":' || t || ',"x":[' || array_to_string(list_sort([a, b]), ',') || ']}}' END AS key FROM c
    """,
    "set_differences": f"""
        WITH {OBJECTS}, s AS (SELECT scene_id, list(DISTINCT CASE WHEN fx > 1 THEN category ELSE colour END) FILTER ((CASE WHEN fx > 1 THEN category ELSE colour END) IS NOT NULL) AS l, list(DISTINCT CASE WHEN fy > 1 THEN category ELSE colour END) FILTER ((CASE WHEN fy > 1 THEN category ELSE colour END) IS NOT NULL) AS r FROM objects GROUP BY 1),
        d AS (SELECT scene_id, list_sort(list_filter(l, lambda x: NOT list_contains(r, x))) AS less, list_sort(list_filter(r, lambda x: NOT list_contains(l, x))) AS more FROM s)
        SELECT scene_id, array_to_string(less, ',') AS only_left, array_to_string(more, ',') AS only_right, CASE WHEN len(less) = 0 AND len(more) = 0 THEN 'equal' WHEN len(less) = 0 THEN 'subset' WHEN len(more) = 0 THEN 'superset' ELSE 'neither' END AS relation FROM d
    """,
    "converted_objects": f"""
        WITH p AS (SELECT *, radians(vec_id % 360) AS h, CASE WHEN vec_id % 4 <> 0 THEN radians(vec_id % 90) END AS f, {_group(0)} AS g0, {_group(1)} AS g1, CASE WHEN vec_id % 3 <> 0 THEN {_group(2)} END AS g2 FROM embeddings)
        SELECT vec_id AS object_id, 'label' || (vec_id % 9) AS label, round(sin(h / 2), 9) AS qz, round(cos(h / 2), 9) AS qw, round(cos(f), 9) AS fx, round(sin(f), 9) AS fy,
               concat_ws(',', nullif(g0, '_'), CASE WHEN g1 <> '_' AND g1 <> g0 THEN g1 END, CASE WHEN g2 <> '_' AND g2 <> g0 AND g2 <> g1 THEN g2 END) AS colours, CASE WHEN vec_id % 3 <> 0 THEN 3 ELSE 2 END AS groups FROM p
    """,
    "cell_issues": r"""
        SELECT o_orderkey, 'clerk' AS "column", 'not_decimal_id' AS code FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT o_orderkey, 'priority', 'not_label' FROM orders WHERE o_orderpriority <> '' AND NOT regexp_full_match(o_orderpriority, '[A-Za-z][A-Za-z ]*')
        UNION ALL SELECT o_orderkey, 'customer', 'empty' FROM orders WHERE o_orderkey % 9 = 0
    """,
    "compact_columns": f"WITH {OBJECTS} SELECT scene_id, object_id, concat_ws(',', CASE WHEN category IS NULL THEN 'category' END, CASE WHEN cx > 0 THEN 'centre' END, CASE WHEN sx > 1 THEN 'size' END, CASE WHEN abs(fx) < 0.5 THEN 'front' END) AS conditional FROM objects",
    "ordered_ids": f"WITH {OBJECTS} SELECT scene_id, object_id, printf('obj_%03d', row_number() OVER (PARTITION BY scene_id ORDER BY category NULLS LAST, cx IS NULL, round(cx, 2) NULLS LAST, round(cy, 2) NULLS LAST, round(cz, 2) NULLS LAST, object_id)) AS name FROM objects",
    "request_product": "SELECT c_custkey, v AS view, f AS format, sha256(concat_ws('|', c_custkey, v, f)) AS request_id FROM customer, (VALUES ('full'), ('known')) AS a(v), (VALUES ('coordinates'), ('relations')) AS b(f)",
}
