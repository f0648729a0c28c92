"""Answers to all commands of all scenes at once: the command's reading as a two- or three-node query, resolved by joins.

An anchor phrase must be settled by its attributes: a possible match makes the answer insufficient, none makes it no_match,
and several definite ones fork, with no arbitrary winner. Each branch classes its targets, and the branches agree or not:
insufficient before resolved (all branches, one target) before no_match (all branches) before ambiguous.

Phrases are matched once for each scene and questions are answered once, however many commands ask them. Nodes travel as
structs, so a branch is a row. Readings, questions, matches and distances are used several times and are written once, by a
checkpoint, which also keeps the plan small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import objects
from ..functions.geometry import centre_distance
from ..operators.clusters import cut
from ..operators.encoding import CATEGORIES, COLOURS, command_texts, commands, phrases
from ..operators.ranking import ranked_uncertain
from ..operators.relations import BINARY, between_state

ASK = ["scene_id", "relation", "k", "target", "first", "second"]
RANKS = ("closest", "farthest")


def matches(things: DataFrame, wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(scene_id, phrase, definite, o): the objects of a scene that are or may be what a phrase names; o is the object."""
    named = wanted.distinct().join(vocabulary.select("phrase", F.col("colour").alias("_colour"), F.col("category").alias("_category")), "phrase")
    held = things.select("scene_id", F.struct(*things.columns).alias("o"))
    state = (F.col("o.category") == F.col("_category")) & (F.col("_colour").isNull() | (F.col("o.colour") == F.col("_colour")))
    return named.join(held, "scene_id").withColumn("_state", state).filter(F.coalesce("_state", F.lit(True))).select("scene_id", "phrase", F.col("_state").isNotNull().alias("definite"), "o")


def classed(rows: DataFrame, keys: list[str], state: Column) -> DataFrame:
    """(keys, status, ids) of each branch from its rows; a branch without targets has one row whose t is null."""
    judged = rows.withColumn("_s", F.when(F.col("t").isNull(), False).otherwise(F.when(F.col("definite"), True) & state))
    ids = F.sort_array(F.collect_list(F.when(F.col("_s"), F.col("t.object_id"))))
    found = judged.groupBy(*keys).agg(ids.alias("ids"), F.count_if(F.col("_s").isNull()).alias("_possible"))
    status = F.when(F.size("ids") >= 2, "ambiguous").when(F.col("_possible") > 0, "insufficient_information").when(F.size("ids") == 1, "resolved").otherwise("no_match")
    return found.select(*keys, status.alias("status"), "ids")


def branch_outcomes(asks: DataFrame, met: DataFrame) -> DataFrame:
    """(ASK, status, ids) of every branch of questions whose anchors are settled."""
    node = lambda phrase, name: met.select("scene_id", F.col("phrase").alias(phrase), "definite", F.col("o").alias(name))
    sure = lambda phrase, name: node(phrase, name).filter("definite").drop("definite")
    bound = asks.join(sure("first", "a"), ["scene_id", "first"]).withColumn("a_id", F.col("a.object_id"))
    targets = node("target", "t")

    keys = [*ASK, "a_id"]
    pairs = bound.filter("second is null").join(targets, ["scene_id", "target"], "left")
    holds = reduce(lambda other, name: F.when(F.col("relation") == name, BINARY[name]()).otherwise(other), BINARY, F.lit(None).cast("boolean"))
    related = classed(pairs.filter(~F.col("relation").isin(*RANKS)), keys, F.when(F.col("t.object_id") == F.col("a_id"), False).otherwise(holds))

    order = pairs.filter(F.col("relation").isin(*RANKS))
    rank_keys = ["scene_id", "relation", "k", "target", "first", "a_id"]  # second is null for all of them
    away = centre_distance() * F.when(F.col("relation") == "farthest", -1).otherwise(1)
    rows = order.filter(F.col("t.object_id") != F.col("a_id")).select(*rank_keys, F.col("t.object_id").alias("candidate_id"), away.alias("distance_m"), (~F.col("definite")).alias("possible"))
    found = ranked_uncertain(cut(rows), rank_keys, F.col("k")).select(*rank_keys, F.col("status").alias("_status"), "object_ids")
    ranks = order.select(*keys).distinct().join(found, rank_keys, "left")
    ranked = ranks.select(*ASK, F.coalesce("_status", F.lit("no_match")).alias("status"), F.coalesce("object_ids", F.array().cast("array<bigint>")).alias("ids"))

    couples = bound.filter("second is not null").join(sure("second", "b"), ["scene_id", "second"]).withColumn("b_id", F.col("b.object_id"))
    triples = couples.filter("a_id <> b_id").join(targets, ["scene_id", "target"], "left")
    between = classed(triples, [*keys, "b_id"], F.when(F.col("t.object_id").isin(F.col("a_id"), F.col("b_id")), False).otherwise(between_state()))
    return related.drop("a_id").unionByName(ranked).unionByName(between.drop("a_id", "b_id"))


def pruned_couples(asks: DataFrame, met: DataFrame) -> DataFrame:
    """(ASK, pruned): of each question with two anchors, how many couples of anchors are one object and make no branch.

    These are the objects that both phrases name for certain: a join of the matches, without making the couples.
    """
    sure = lambda phrase: met.filter("definite").select("scene_id", F.col("phrase").alias(phrase), F.col("o.object_id").alias("object_id"))
    both = asks.filter("second is not null").join(sure("first"), ["scene_id", "first"]).join(sure("second"), ["scene_id", "second", "object_id"])
    return both.groupBy(*ASK).agg(F.count(F.lit(1)).alias("pruned"))


def answers(asked: DataFrame, things: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(scene_id, text, status, reason, target_id, ids, pruned) of each distinct command of a scene; ``pruned`` counts the couples of anchors that are one object."""
    every = asked.select("scene_id", "text").distinct()
    readings = cut(commands(every, vocabulary))
    parsed = every.join(readings, "text").withColumn("first", F.get(F.split("anchors", r"\|"), F.lit(0))).withColumn("second", F.get(F.split("anchors", r"\|"), F.lit(1)))
    asks = cut(parsed.filter("status = 'parsed'").select(*ASK).distinct())
    wanted = reduce(DataFrame.unionByName, [asks.select("scene_id", F.col(c).alias("phrase")) for c in ("target", "first", "second")]).filter("phrase is not null")
    met = cut(matches(things, wanted, vocabulary))
    counts = met.groupBy("scene_id", "phrase").agg(F.count_if("definite").alias("n"), F.count_if(~F.col("definite")).alias("m"))
    sided = lambda c: counts.select("scene_id", F.col("phrase").alias(c), F.col("n").alias(f"n_{c}"), F.col("m").alias(f"m_{c}"))
    gated = asks.join(sided("first"), ["scene_id", "first"], "left").join(sided("second"), ["scene_id", "second"], "left").fillna(0, ["n_first", "m_first", "n_second", "m_second"])
    stop = F.when(F.col("m_first") > 0, "insufficient_information").when(F.col("n_first") == 0, "no_match")
    stop = stop.when(F.col("second").isNotNull() & (F.col("m_second") > 0), "insufficient_information").when(F.col("second").isNotNull() & (F.col("n_second") == 0), "no_match")
    gated = cut(gated.select(*ASK, stop.alias("stop")))
    is_ = lambda name: F.col("status") == name
    going = gated.filter("stop is null").select(*ASK)
    merged = branch_outcomes(going, met).groupBy(*ASK).agg(
        *[F.bool_or(is_(s)).alias(f"any_{s}") for s in ("budget_exceeded", "insufficient_information")],
        F.bool_and(is_("resolved")).alias("all_resolved"),
        F.bool_and(is_("no_match")).alias("all_missing"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"),
    )
    status = F.when(F.col("any_budget_exceeded"), "budget_exceeded").when(F.col("any_insufficient_information"), "insufficient_information")
    status = status.when(F.col("all_resolved") & (F.size("ids") == 1), "resolved").when(F.col("all_missing"), "no_match").otherwise("ambiguous")
    same = lambda x, y: reduce(lambda p, q: p & q, [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in ASK])
    found = gated.alias("g").join(merged.withColumn("found", status).alias("m"), same("g", "m"), "left").select("g.*", F.coalesce("stop", "found", F.lit("no_match")).alias("answer"), "m.ids")
    settled = found.alias("g").join(pruned_couples(going, met).alias("n"), same("g", "n"), "left").select("g.*", F.coalesce("n.pruned", F.lit(0)).alias("pruned"))
    joined = parsed.alias("p").join(settled.alias("q"), same("p", "q"), "left")
    ids = F.coalesce("q.ids", F.array().cast("array<bigint>"))
    return joined.select("p.scene_id", "p.text", F.coalesce("q.answer", "p.status").alias("status"), "p.reason", F.when(F.col("q.answer") == "resolved", F.get(ids, F.lit(0))).alias("target_id"), ids.alias("ids"), F.coalesce("q.pruned", F.lit(0)).alias("pruned"))


def q_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every templated command about its own scene, over all its objects; one of unknown category may be whatever a phrase of its colour names."""
    things = objects(spark, sf_dir)
    asked = command_texts(spark, sf_dir).join(objects(spark, sf_dir).select("object_id", "scene_id"), "object_id")
    return answers(asked, things, phrases(spark, CATEGORIES, COLOURS)).withColumn("ids", F.array_join("ids", ","))


QUERIES = {"command_answers": q_answers}
SQL: dict[str, str] = {}
