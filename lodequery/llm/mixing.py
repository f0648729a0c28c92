"""Mixing sources to target weights: exact block quotas, a multivariate-hypergeometric splitting tree, permuted blocks.

Targets: sources take the weights in turn by code point order (null last) and share ``TOTAL`` times all words;
a target stops at ``MOST`` times its source and the excess is shared again by weight (solved in one pass: sorted by
the level at which each source fills up).

Quotas: a source is cut into blocks of about ``BLOCK_ROWS`` rows by a hash of id and text. It is taken in whole
epochs of all its blocks and one epoch of the first blocks in a hash order, up to the word, so only the document at
the end of a quota is taken in part. How many blocks that is, is the source's exact quota.

Tree: the quotas of all sources are split over the output shards. A node halves its shards and draws how many
blocks of each source go left from the multivariate hypergeometric distribution, one source after the other, given those
before; down to single shards. A draw inverts the distribution at a hash of node and source, so reruns agree. The
drawn blocks of a source are permuted by another hash, and each shard takes the next ones of the permutation, as many as
the tree gave it: shards are disjoint, and each is a fair sample without replacement. Rows are shuffled by hash inside a shard.

No task holds a source: sums and places run over strata of blocks and then over the strata, and within a block over its
rows. The tree runs in one task over one row for each source; it is meant for sources in the thousands, not millions. There are
``LEAST_SHARDS`` output shards, or one for each ``SHARD_WORDS`` words if that is more.

Edge cases: a null text has no words and is never taken; a source without words has target 0. Rows that repeat an
id are rows of their own; rows that repeat id and text share a block. A null id is hashed as the word null. An empty table gives
an empty result. With ``payload`` the input's columns are carried in a struct, so their names and types cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, join_small, name, table, whole_row

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
TOTAL, MOST = 1.5, 2.0
BLOCK_ROWS = 64
STRATUM_BLOCKS = 4096
LEAST_SHARDS, SHARD_WORDS = 32, 64_000_000
SEED = "mix-1"
SPAN = 2**52


def hashed(*parts: Column) -> Column:
    """52 bits of a digest of the parts, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts)), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, n, source_size, target) from (source, size); one row for each source."""
    every = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn % len(WEIGHTS) + 1).cast("int"))
    ranked = every.withColumn("weight", weight).withColumn("full_at", MOST * F.col("source_size") / F.col("weight"))
    up = Window.orderBy("full_at", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (TOTAL * F.sum("source_size").over(whole) - MOST * F.coalesce(F.sum("source_size").over(up), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up), F.lit(0)))
    solved = ranked.withColumn("level", level).withColumn("fits", F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level")))
    common = F.min("fits").over(whole)["level"]
    filled = F.least(MOST * F.col("source_size"), F.coalesce(common, F.lit(float("inf"))) * F.col("weight"))
    return solved.select("source", "n", "source_size", filled.cast("double").alias("target"))


def go_left(k: int, rest: int, want: int, u: float) -> int:
    """How many of ``k`` items are among ``want`` drawn from ``k + rest``: the hypergeometric distribution inverted at ``u``.

    Only values within 40 standard deviations are weighed; those beyond have no mass that a double could hold.
    """
    low, high = max(0, want - rest), min(k, want)
    if low == high:
        return low
    whole = k + rest
    mean, wide = want * k / whole, 40 * math.sqrt(want * k * rest * (whole - want)) / whole**1.5 + 60
    x = np.arange(max(low, int(mean - wide)), min(high, int(mean + wide)) + 1, dtype=np.float64)
    steps = np.log((k - x[:-1]) * (want - x[:-1])) - np.log((x[:-1] + 1) * (rest - want + x[:-1] + 1))
    log = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(log - log.max()))
    return int(x[min(np.searchsorted(upto, u * upto[-1]), len(x) - 1)])


def split_quotas(drawn: pd.DataFrame, shards: int) -> np.ndarray:
    """(sources, shards): how many of each source's drawn blocks each shard gets."""
    out = np.zeros((len(drawn), shards), np.int64)
    keys = drawn["source_key"].tolist()
    todo = [(0, shards, drawn["drawn"].to_numpy(np.int64))]
    while todo:
        first, last, have = todo.pop()
        if last - first == 1:
            out[:, first] = have
            continue
        middle, rest = (first + last) // 2, int(have.sum())
        want = rest * (middle - first) // (last - first)
        go = np.zeros_like(have)
        for i, k in enumerate(have.tolist()):
            rest -= k
            draw = int(hashlib.md5(f"{SEED}|tree|{first}|{last}|{keys[i]}".encode()).hexdigest()[:13], 16)
            go[i] = go_left(k, rest, want, (draw + 0.5) / SPAN)
            want -= int(go[i])
        todo += [(first, middle, go), (middle, last, have - go)]
    return out


def running(df: DataFrame, order: Column, value: Column, ties: list[str], out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over what comes before within source_key, in two steps: inside strata of the order, and over the strata."""
    dealt = df.withColumn("_order", order).withColumn("_stratum", F.floor(F.col("_order") / F.lit(SPAN) * F.col("strata"))).withColumn("_value", value)
    sums = dealt.groupBy("source_key", "_stratum").agg(F.sum("_value").alias("_sum"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source_key", "_stratum", F.coalesce(F.sum("_sum").over(before.partitionBy("source_key").orderBy("_stratum")), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_value").over(before.partitionBy("source_key", "_stratum").orderBy("_order", *ties)), F.lit(0))
    return dealt.withColumn("_inside", inside).join(starts, ["source_key", "_stratum"]).withColumn(out, F.col("_start") + F.col("_inside")).drop("_order", "_stratum", "_value", "_inside", "_start")


def dealt_blocks(blocks: DataFrame, shards: int) -> DataFrame:
    """(source_key, block, before, draws): draws are the (epoch, shard) pairs of a block."""
    quota = blocks.groupBy("source_key").agg(F.sum(F.col("epochs") + (F.col("before") < F.col("rest")).cast("long")).alias("drawn"))

    def tree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat([*batches, pd.DataFrame({"source_key": [], "drawn": []})]).sort_values("source_key", kind="stable").reset_index(drop=True)
        if len(every):
            upto = np.cumsum(split_quotas(every, shards), axis=1)
            yield pd.DataFrame({"source_key": every["source_key"], "upto": [x.tolist() for x in upto]})

    quotas = durable(quota.coalesce(1).mapInPandas(tree, "source_key string, upto array<bigint>"))  # one row for each source
    epoch = F.explode(F.expr("sequence(0, int(epochs))"))
    drawn = blocks.select("source_key", "block", "epochs", "before", "rest", "strata", epoch.alias("epoch")).filter((F.col("epoch") < F.col("epochs")) | (F.col("before") < F.col("rest")))
    turned = running(drawn, hashed(F.lit("turn"), "source_key", F.col("block").cast("string"), F.col("epoch").cast("string")), F.lit(1), ["block", "epoch"], "turn")
    placed = join_small(turned, quotas, ["source_key"])
    shard = F.size(F.filter("upto", lambda x: x <= F.col("turn")))
    draws = placed.groupBy("source_key", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", shard.alias("shard")))).alias("draws"))
    return blocks.join(draws, ["source_key", "block"], "left")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, payload: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, source, size, source_size, target, draws (and row, with ``payload``).

    ``draws`` has an entry (epoch, shard, words) for each time the document is taken, in whole or in part.
    """
    text, own = F.coalesce(F.col(name(text_col)), F.lit("")), F.coalesce(F.col(name(id_col)).cast("string"), F.lit("null"))
    slim = docs.select(
        F.col(name(id_col)).alias("id"),
        F.col(name(source_col)).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(name(source_col))), F.lit("n")).alias("source_key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.concat_ws("|", own, F.md5(text)).alias("key"),
        *([whole_row(docs).alias("row")] if payload else []),
    )
    sizes = durable(slim.drop("row"))
    plan = durable(
        targets(sizes)
        .withColumn("quota", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("source_size"))
        .withColumn("cuts", F.ceil(F.col("n") / BLOCK_ROWS).cast("long"))
        .withColumn("strata", F.ceil(F.col("cuts") / STRATUM_BLOCKS))
        .withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
        .drop("source", "n")
    )
    shards = shards or max(LEAST_SHARDS, math.ceil((plan.agg(F.sum("quota")).first()[0] or 0) / SHARD_WORDS))

    def in_blocks(rows: DataFrame) -> DataFrame:
        return join_small(rows, plan, ["source_key"]).withColumn("block", hashed(F.lit("block"), "key") % F.col("cuts"))

    blocks = in_blocks(sizes).groupBy("source_key", "block", "epochs", "rest", "strata").agg(F.sum("size").alias("words"))
    ordered = running(blocks, hashed(F.lit("order"), "source_key", F.col("block").cast("string")), F.col("words"), ["block"], "before")
    dealt = durable(dealt_blocks(durable(ordered), shards).select("source_key", "block", "before", "draws"))
    inside = Window.partitionBy("source_key", "block").orderBy(hashed(F.lit("row"), "key"), "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = in_blocks(slim if payload else sizes).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(dealt, ["source_key", "block"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("inside")))
    taken = F.transform("draws", lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.when(d["epoch"] < F.col("epochs"), F.col("size")).otherwise(F.col("part")).cast("long").alias("words")))
    with_draws = rows.withColumn("part", part).withColumn("draws", F.filter(F.coalesce(taken, F.expr("array()")), lambda d: d["words"] > 0))
    return with_draws.select("id", "source", "size", "source_size", "target", "draws", *(["row", F.lit(shards).alias("shards")] if payload else []))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time a document is taken, shuffled within output shards.

    A document taken in part keeps its first words, joined by one space; ``n_chars``, if there, follows.
    """
    whole = mix(docs, id_col, text_col, source_col, shards, payload=True)
    drawn = whole.select("row", "size", F.explode("draws").alias("draw"))
    own = F.col("row").getField(text_col)
    text = F.when(F.col("draw.words") >= F.col("size"), own).otherwise(F.array_join(F.slice(F.regexp_extract_all(own, F.lit(WORD), F.lit(0)), F.lit(1), F.col("draw.words").cast("int")), " "))
    placed = drawn.withColumn("_text", text).withColumn("_shard", F.col("draw.shard"))
    order = F.xxhash64(F.lit(SEED), F.col("row").getField(id_col), F.col("draw.epoch"), F.col("size"))
    shuffled = placed.repartition("_shard").sortWithinPartitions("_shard", order)
    value = {text_col: F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return shuffled.select(*[value.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda total, d: total + d["words"])
    draws = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["epoch"].cast("string"), d["shard"].cast("string"), d["words"].cast("string"))), ",")
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), draws.alias("draws"))


QUERIES = {"op10_mixing": op10_mixing}
SQL = {
    "op10_mixing": rf"""
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, coalesce('s' || source, 'n') AS source_key, coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, '')) AS key,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
            FROM documents
        ), sources AS (
            SELECT source, source_key, count(*) AS n, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL
        ), weighed AS (
            SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sources
        ), levels AS (
            SELECT *, 2.0::DOUBLE * source_size / weight AS full_at,
                   (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level
            FROM weighed WINDOW up AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), plan AS (
            SELECT *, least(2.0::DOUBLE * source_size, (SELECT arg_min(level, full_at) FROM levels WHERE level <= full_at) * weight) AS target FROM levels
        ), quotas AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS epochs, round(target)::BIGINT AS quota, ceil(n / {BLOCK_ROWS})::BIGINT AS cuts FROM plan
        ), blocked AS (
            SELECT d.*, q.source_size, q.target, q.epochs, q.quota - q.epochs * q.source_size AS rest,
                   ('0x' || substr(md5('{SEED}|block|' || key), 1, 13))::BIGINT % cuts AS block
            FROM sized d JOIN quotas q USING (source_key)
        ), blocks AS (
            SELECT source_key, block, epochs, rest, sum(size)::BIGINT AS words, substr(md5('{SEED}|order|' || source_key || '|' || block), 1, 13) AS digest FROM blocked GROUP BY ALL
        ), placed AS (
            SELECT *, coalesce(sum(words) OVER (PARTITION BY source_key ORDER BY digest, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM blocks
        ), draws AS (
            SELECT source_key, block, epoch, row_number() OVER (PARTITION BY source_key ORDER BY substr(md5('{SEED}|turn|' || source_key || '|' || block || '|' || epoch), 1, 13), block, epoch) - 1 AS turn
            FROM (SELECT *, unnest(range(epochs + 1)) AS epoch FROM placed) WHERE epoch < epochs OR before < rest
        ), drawn AS (
            SELECT list(source_key ORDER BY source_key) AS keys, list(n ORDER BY source_key) AS have FROM (SELECT source_key, count(d.epoch) AS n FROM quotas LEFT JOIN draws d USING (source_key) GROUP BY ALL)
        ), tree AS (
            SELECT 0::BIGINT AS first, greatest({LEAST_SHARDS}, ceil((SELECT sum(quota) FROM quotas) / {SHARD_WORDS}))::BIGINT AS last, keys, have, []::BIGINT[] AS go FROM drawn
            UNION ALL
            SELECT s.first, s.last, keys, s.have, s.go FROM (
                SELECT keys, unnest(CASE
                    WHEN len(go) < len(have) THEN [{{'first': first, 'last': last, 'have': have, 'go': list_append(go, left_of)}}]
                    ELSE [{{'first': first, 'last': (first + last) // 2, 'have': go, 'go': []::BIGINT[]}},
                          {{'first': (first + last) // 2, 'last': last, 'have': list_transform(range(1, len(have) + 1), lambda i: have[i] - go[i]), 'go': []::BIGINT[]}}] END) AS s
                FROM (
                    SELECT *, low + len(list_filter(range(1, len(mass) + 1), lambda j: list_sum(mass[1:j]) < u)) AS left_of
                    FROM (
                        SELECT *, list_transform(range(low, high + 1), lambda x: exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(others + 1) - lgamma(want - x + 1) - lgamma(others - want + x + 1)
                                                                                    - lgamma(k + others + 1) + lgamma(want + 1) + lgamma(k + others - want + 1))) AS mass
                        FROM (
                            SELECT *, greatest(0, want - others) AS low, least(k, want) AS high
                            FROM (
                                SELECT *, coalesce(have[len(go) + 1], 0) AS k, coalesce(list_sum(have[len(go) + 2:]), 0)::BIGINT AS others,
                                       (list_sum(have)::BIGINT * ((first + last) // 2 - first)) // (last - first) - coalesce(list_sum(go), 0)::BIGINT AS want,
                                       (('0x' || substr(md5('{SEED}|tree|' || first || '|' || last || '|' || coalesce(keys[len(go) + 1], '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {SPAN} AS u
                                FROM tree WHERE last - first > 1
                            )
                        )
                    )
                )
            )
        ), shares AS (
            SELECT first AS shard, unnest(keys) AS source_key, unnest(have) AS n FROM tree WHERE last - first = 1
        ), upto AS (
            SELECT source_key, shard, sum(n) OVER (PARTITION BY source_key ORDER BY shard) AS upto FROM shares
        ), dealt AS (
            SELECT d.source_key, block, epoch, count(u.shard) AS shard FROM draws d LEFT JOIN upto u ON d.source_key = u.source_key AND u.upto <= d.turn GROUP BY ALL
        ), rows_in AS (
            SELECT *, row_number() OVER () AS row_id, coalesce(sum(size) OVER (PARTITION BY source_key, block ORDER BY substr(md5('{SEED}|row|' || key), 1, 13), key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM blocked
        ), parts AS (
            SELECT r.*, d.epoch, d.shard, CASE WHEN d.epoch < r.epochs THEN size ELSE greatest(0, least(size, r.rest - before - inside)) END::BIGINT AS words
            FROM rows_in r JOIN placed p USING (source_key, block) LEFT JOIN dealt d USING (source_key, block)
        )
        SELECT doc_id, size, source_size, target, coalesce(sum(words) FILTER (epoch IS NOT NULL), 0)::BIGINT AS taken,
               coalesce(string_agg(epoch || ':' || shard || ':' || words, ',' ORDER BY epoch) FILTER (words > 0), '') AS draws
        FROM parts GROUP BY row_id, doc_id, size, source_size, target
    """
}
