"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn in turn.

At each level the children of a node compete for a row: child c with weight w draws -ln(u) / w from a
hash u of (row id, path of c) and the smallest draw wins, so each child gets rows in proportion to its
weight and draws do not depend on its siblings. A changed weight moves rows only into or out of that
subtree. A shard that is added becomes a subtree of its own at the root, so rows move only into it.

Edge cases: a null id is hashed as the word null. Rows that repeat an id get the same shard and
different slots. A null text has size 1 and the checksum of nothing. An empty table gives an empty
result. Extra columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

#: Rows of a shard are numbered in so many hash buckets, so no task holds a whole shard.
BUCKETS = 256
FIXED_SHARDS = 16


@dataclass(frozen=True)
class Node:
    """A subtree: its path names it in the hash; a leaf has a shard number."""

    path: str
    weight: float
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None


def regions(shards: int = FIXED_SHARDS, racks: int = 2, per_rack: int = 2) -> Node:
    """A tree of regions of ``racks`` racks of ``per_rack`` shards of weight 1."""
    tops, first = [], 0
    while first < shards:
        inner = []
        for k in range(racks):
            numbers = range(first + k * per_rack, min(shards, first + (k + 1) * per_rack))
            leaves = tuple(Node(f"{first}/{k}/{n}", 1.0, shard=n) for n in numbers)
            if leaves:
                inner.append(Node(f"{first}/{k}", float(len(leaves)), leaves))
        tops.append(Node(str(first), sum(x.weight for x in inner), tuple(inner)))
        first += racks * per_rack
    return Node("", float(shards), tuple(tops))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, as a subtree at the root."""
    return Node(tree.path, tree.weight + weight, (*tree.children, Node(f"+{shard}", weight, shard=shard)))


def draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of a digest of key and path."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{node.path}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / F.lit(node.weight)


def descend(df: DataFrame, key: str, tree: Node, out: str) -> DataFrame:
    """Adds ``out``: the shard that the row reaches, level by level, in built-in functions."""
    levels, nodes = [], [tree]
    while any(n.children for n in nodes):
        levels.append([n for n in nodes if n.children])
        nodes = [c for n in nodes for c in n.children]
    leaf = {n.path: n.shard for level in levels for p in level for n in p.children if n.shard is not None}
    df = df.withColumn("_at", F.lit(""))
    for level in levels:
        choice = None
        for node in level:
            least = F.array_min(F.array(*[F.struct(draw(F.col(key), c).alias("draw"), F.lit(c.path).alias("path")) for c in node.children]))["path"]
            choice = F.when(F.col("_at") == node.path, least) if choice is None else choice.when(F.col("_at") == node.path, least)
        df = df.withColumn("_at", choice.otherwise(F.col("_at")))
    shard = F.create_map(*[F.lit(x) for pair in leaf.items() for x in pair])
    return df.withColumn(out, F.element_at(shard, F.col("_at")).cast("int")).drop("_at")


def slots(df: DataFrame, shard: str, key: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds slot: gapless numbers from 0 in each shard, by bucket and then by ``order``.

    Two steps: rows are numbered within a bucket of a shard, and buckets get the count of those before
    them (a table of shards times ``buckets`` rows, which is broadcast).
    """
    dealt = df.withColumn("_bucket", F.conv(F.substring(F.md5(F.concat(F.col(key), F.lit("|slot"))), 1, 2), 16, 10).cast("int") % buckets)
    counts = dealt.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(counts.select(shard, "_bucket", F.coalesce(before, F.lit(0)).alias("_start")))
    within = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order))
    return dealt.withColumn("_k", within).join(starts, [shard, "_bucket"]).withColumn("slot", F.col("_start") + F.col("_k") - 1).drop("_bucket", "_k", "_start")


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = FIXED_SHARDS) -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, law (key), shard, slot and the shard after one more is added."""
    tree = regions(shards)
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_key"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
    )
    placed = descend(descend(slim, "_key", tree, "shard"), "_key", grown(tree, shards), "grown_shard")
    numbered = slots(durable(placed), "shard", "_key", ["id", "text_crc32", "size"])
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"))


QUERIES = {"op7_shards": op7_shards}
SQL: dict[str, str] = {}
