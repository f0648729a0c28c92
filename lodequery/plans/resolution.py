"""Structured object queries: a graph of nodes with categories, colours, relations and ranks, resolved per scene.

A query is validated, its nodes are put in topological order (the smallest ready name first), and each node becomes
a step of joins over all scenes at once: candidates of the node, bound anchors from the nodes before, three-valued
relation states. A node with two definite candidates is ambiguous before any possible one makes it insufficient.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import OBJECTS, objects
from ..operators.ranking import ranked
from ..operators.relations import BINARY
from ..functions.geometry import centre_distance


@dataclass(frozen=True)
class Query:
    """A node: what it is, the relations it must have to other nodes, and at most one rank."""

    name: str
    category: str | None = None
    colours: tuple[str, ...] = ()
    constraints: tuple[tuple[str, str], ...] = ()  # (relation, name of the anchor node)
    rank: tuple[str, str, int] | None = None  # (closest or farthest, name of the anchor node, k)
    needs: tuple[str, ...] = field(default=(), compare=False)


def ordered(nodes: tuple[Query, ...]) -> list[Query]:
    """Topological order, smallest ready name first; errors name what is wrong."""
    named = {n.name: n for n in nodes}
    if len(named) < len(nodes):
        raise ValueError("duplicate_node")
    wants = {n.name: {a for _, a in n.constraints} | ({n.rank[1]} if n.rank else set()) for n in nodes}
    if missing := {a for w in wants.values() for a in w} - named.keys():
        raise ValueError(f"unknown_anchor: {sorted(missing)}")
    if unknown := {r for n in nodes for r, _ in n.constraints} - BINARY.keys():
        raise ValueError(f"unknown_relation: {sorted(unknown)}")
    if any(n.rank and n.rank[2] not in (1, 2, 3) for n in nodes):
        raise ValueError("rank_out_of_range")
    out: list[Query] = []
    while wants:
        ready = sorted(n for n, w in wants.items() if not w & wants.keys())
        if not ready:
            raise ValueError("cycle")
        out.append(named[ready[0]])
        del wants[ready[0]]
    return out


def attributes(node: Query) -> Column:
    """Category and colours of a candidate, three-valued; an unknown category is unknown unless a colour fails."""
    tests = [F.col("t.colour") == c for c in node.colours]
    if node.category is not None:
        tests.append(F.col("t.category") == node.category)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def node_candidates(things: DataFrame, node: Query, bound: dict[str, DataFrame]) -> DataFrame:
    """(scene_id, object_id, definite) of the objects that may be the node; certain failures are gone."""
    state = things.alias("t").select("t.*", attributes(node).alias("state"))
    for relation, anchor in node.constraints:
        at = bound[anchor].filter("status = 'resolved'").select("scene_id", F.element_at("ids", 1).alias("anchor_id"))
        anchors = things.alias("x").join(at.alias("b"), (F.col("x.scene_id") == F.col("b.scene_id")) & (F.col("x.object_id") == F.col("b.anchor_id"))).select("x.*")
        pair = state.alias("t").join(anchors.alias("a"), F.col("t.scene_id") == F.col("a.scene_id"))
        holds = F.when(F.col("t.object_id") == F.col("a.object_id"), False).otherwise(BINARY[relation]())
        state = pair.select(*[F.col(f"t.{c}") for c in things.columns], (F.col("t.state") & holds).alias("state"))
    return state.filter(F.coalesce("state", F.lit(True))).select("scene_id", "object_id", F.col("state").isNotNull().alias("definite"))


def node_result(things: DataFrame, node: Query, bound: dict[str, DataFrame]) -> DataFrame:
    """(scene_id, status, ids) of a node in every scene; anchors that are not resolved pass their status on."""
    scenes = things.select("scene_id").distinct()
    kept = node_candidates(things, node, bound)
    if node.rank:
        kind, anchor, k = node.rank
        at = bound[anchor].filter("status = 'resolved'").select("scene_id", F.element_at("ids", 1).alias("anchor_id"))
        where = things.alias("a").join(at.alias("b"), (F.col("a.scene_id") == F.col("b.scene_id")) & (F.col("a.object_id") == F.col("b.anchor_id"))).select("a.*")
        members = kept.alias("k").join(things.alias("o"), ["scene_id", "object_id"]).select("o.*", "definite")
        rows = members.alias("t").join(where.alias("a"), (F.col("t.scene_id") == F.col("a.scene_id")) & (F.col("t.object_id") != F.col("a.object_id"))).select(F.col("t.scene_id"), F.col("t.object_id").alias("candidate_id"), F.when(F.col("definite"), centre_distance()).alias("distance_m"))
        found = ranked(rows, ["scene_id"], k, kind == "farthest").withColumnRenamed("object_ids", "ids")
    else:
        ids = F.sort_array(F.collect_list(F.when(F.col("definite"), F.col("object_id"))))
        classed = kept.groupBy("scene_id").agg(ids.alias("ids"), F.count_if(~F.col("definite")).alias("possible"))
        status = F.when(F.size("ids") >= 2, "ambiguous").when(F.col("possible") > 0, "insufficient_information").when(F.size("ids") == 1, "resolved").otherwise("no_match")
        found = classed.select("scene_id", status.alias("status"), "ids")
    result = scenes.join(found, "scene_id", "left").select("scene_id", F.coalesce("status", F.lit("no_match")).alias("status"), F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))
    for anchor in sorted({a for _, a in node.constraints} | ({node.rank[1]} if node.rank else set())):
        before = bound[anchor].select("scene_id", F.col("status").alias("before"))
        stop = F.when(F.col("before") == "no_match", "anchor_not_found").when(F.col("before") != "resolved", "uncertain_anchor")
        result = result.join(before, "scene_id").select("scene_id", F.coalesce(stop, "status").alias("status"), F.when(stop.isNull(), F.col("ids")).otherwise(F.array().cast("array<bigint>")).alias("ids"))
    return result


def resolve(things: DataFrame, nodes: tuple[Query, ...], root: str) -> DataFrame:
    """(scene_id, status, ids) of the root node in every scene."""
    bound: dict[str, DataFrame] = {}
    for node in ordered(nodes):
        bound[node.name] = node_result(things, node, bound)
    return bound[root]


def q_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each scene the red chair closest to the lamp farthest from the door: three nodes, two ranks."""
    things = objects(spark, sf_dir).filter("cx is not null").withColumn("first", F.lit(0))
    first = things.filter("category = 'table'").groupBy("scene_id").agg(F.min("object_id").alias("object_id")).withColumn("pick", F.lit("door"))
    marked = things.join(first, ["scene_id", "object_id"], "left").withColumn("category", F.coalesce("pick", "category")).drop("pick", "first")
    nodes = (Query("door", category="door"), Query("lamp", category="lamp", rank=("farthest", "door", 1)), Query("chair", category="chair", colours=("red",), rank=("closest", "lamp", 1)))
    return resolve(marked.filter(F.col("category").isNotNull()), nodes, "chair").withColumn("ids", F.array_join("ids", ","))


QUERIES = {"resolve_query": q_resolve}


def _isle(name: str, anchors: str, extra: str, sign: str) -> str:
    return f"""
        {name}_c AS (SELECT t.scene_id, t.object_id AS cid, {sign}sqrt(pow(t.cx - a.cx, 2) + pow(t.cy - a.cy, 2) + pow(t.cz - a.cz, 2)) AS d FROM k t JOIN {anchors} a ON t.scene_id = a.scene_id AND t.object_id <> a.object_id WHERE {extra}),
        {name}_s AS (SELECT *, row_number() OVER w AS place, CASE WHEN d - lag(d) OVER w > 0.05 THEN 1 ELSE 0 END AS jump FROM {name}_c WINDOW w AS (PARTITION BY scene_id ORDER BY d, cid)),
        {name}_i AS (SELECT *, sum(jump) OVER (PARTITION BY scene_id ORDER BY d, cid) AS isle FROM {name}_s),
        {name} AS (SELECT scene_id, list(cid ORDER BY cid) AS ids FROM {name}_i WHERE isle = 0 GROUP BY 1)
    """


SQL = {
    "resolve_query": f"""
        WITH {OBJECTS}, k0 AS (SELECT * FROM objects WHERE cx IS NOT NULL AND category IS NOT NULL), m AS (SELECT scene_id, min(object_id) AS object_id FROM k0 WHERE category = 'table' GROUP BY 1),
        k AS (SELECT k0.* REPLACE (CASE WHEN m.object_id IS NOT NULL THEN 'door' ELSE category END AS category) FROM k0 LEFT JOIN m USING (scene_id, object_id)), door AS (SELECT * FROM k WHERE category = 'door'),
        {_isle('lamp', 'door', "t.category = 'lamp'", '-')}, spot AS (SELECT k.* FROM k JOIN lamp ON k.scene_id = lamp.scene_id AND len(ids) = 1 AND k.object_id = ids[1]), {_isle('chair', 'spot', "t.category = 'chair' AND t.colour = 'red'", '')}
        SELECT s.scene_id, CASE WHEN d.scene_id IS NULL OR l.ids IS NULL THEN 'anchor_not_found' WHEN len(l.ids) > 1 THEN 'uncertain_anchor' WHEN c.ids IS NULL THEN 'no_match' WHEN len(c.ids) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, array_to_string(coalesce(c.ids, []), ',') AS ids
        FROM (SELECT DISTINCT scene_id FROM k) s LEFT JOIN door d USING (scene_id) LEFT JOIN lamp l USING (scene_id) LEFT JOIN chair c USING (scene_id)
    """,
}
