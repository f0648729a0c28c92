"""Connected components of a link table, by hooking and pointer jumping in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, hot_keys, join_unique


#: Link rows up to which one partition holds them: the rounds then shuffle nothing.
SMALL_LINKS = 100_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, root) for each node of ``links``; root is the smallest node of its component.

    Every round hooks a node and its present root to the smallest root among its neighbours, then
    jumps to the root's root, so long chains halve. The lineage is cut by a checkpoint each round.
    Nodes of many links and roots of many nodes are joined by broadcast, the rest by shuffle. An empty table gives an
    empty result; a self-link is a component of one. Up to SMALL_LINKS rows, counted first, are worked through in one partition with broadcasts, as
    a shuffle of so few rows costs only its tasks, in every round.
    """
    both = durable(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    small = both.limit(SMALL_LINKS + 1).count() <= SMALL_LINKS
    one = lambda df: df.coalesce(1) if small else df
    kept = lambda df: one(durable(df))
    side = lambda df: F.broadcast(df) if small else df
    both = one(both)
    labels = kept(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).withColumnRenamed("x", "node"))
    hubs = None if small else hot_keys(both, ["y"])
    for _ in range(most_rounds):
        others = labels.select(F.col("node").alias("y"), F.col("root").alias("far"))
        met = both.join(side(others), "y") if hubs is None else join_unique(both, others, ["y"], hot=hubs)
        far = met.groupBy("x").agg(F.min("far").alias("far"))
        seen = labels.join(side(far), labels["node"] == far["x"]).select("node", "root", F.least("root", "far").alias("low"))
        lows = one(seen.select("node", "low").unionByName(seen.select(F.col("root").alias("node"), "low")))
        hooks = kept(lows.groupBy("node").agg(F.min("low").alias("low")))
        jump = hooks.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        # a root is a node itself, so it has a hook
        moved = (hooks.join(side(jump), "low") if small else join_unique(hooks, jump, ["low"])).select("node", F.least("low", "lower").alias("root"))
        after = kept(moved)
        changed = after.join(side(labels.withColumnRenamed("root", "was")), "node").filter("root <> was").limit(1).count()
        labels = after
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
