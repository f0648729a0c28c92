"""Substring deduplication: words in windows of 50 that also start in a document of smaller id are removed.

1. Every window is named by its minimiser, the smallest hash of the runs of ``GRAM`` words in it, so equal windows
   have equal names wherever they stand. A document is a sequence of segments, runs of windows with one
   name (at most 50 windows each). Only (name, digest, place) travels, not words.
2. Names met in one document only are dropped. Equal segments are merged with a map-side combine: all but the
   smallest document lose them whole. What is left are distinct segments that share a name.
3. Their words go to shards by name. A shard builds a compressed FM-index (wavelet matrix) of its segments and
   streams the same segments against it by backward search, with the smallest document of each suffix range;
   windows whose matching statistic reaches 50 within smaller documents are reported as intervals.
   A shard holds ``SHARD_WORDS`` words on average. A name with more than ``HEAVY`` distinct segments does not
   enter a shard: its windows are compared by 128-bit digests in a grouped minimum, which is as exact and knows
   no hot task.
4. Intervals go back to their documents, and to every place where the segment's smallest document repeats it.

Words are compared by 64-bit hashes, whole segments by their name and a digest of 64 bits each, windows by 128 bits. Joins on
names and segments broadcast the hot keys (``join_unique``).

Edge cases: null is the empty text; fewer than 50 words hold no window and nothing is removed. A null id
is larger than all others. Rows that share an id do not remove each other's words. Repeats inside one document
are kept. An empty table gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, map_batches, map_with_id, name, table, utf8, written
from .fingerprints import MULTIPLIER, mixed
from .fm_index import FMIndex

WINDOW, GRAM = 50, 6
SHARD_WORDS = 300_000
HEAVY = SHARD_WORDS // (2 * WINDOW - 1)  # distinct segments of one name that still fit one shard
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 2**64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def range_digests(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A digest of each range of words that does not depend on where the range stands."""
    up = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(MULTIPLIER, len(hashes)), out=up[1:])
    return mixed((up[last] - up[first]) * powers(INVERSE, len(hashes) + 1)[first])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` successive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def segments(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, number of windows) of each run of windows with one minimiser, ``window`` windows at most."""
    if len(hashes) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    total = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        total = total * MULTIPLIER + hashes[k : len(hashes) - gram + 1 + k]
    least = sliding_least(mixed(total), window - gram + 1)
    fresh = np.concatenate([[True], least[1:] != least[:-1]])
    run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    starts = np.flatnonzero(fresh | ((np.arange(len(least)) - run) % window == 0))
    return least[starts], starts, np.diff(np.append(starts, len(least)))


#: The order of documents: null ids (lost, with id 0) come after all others.
OWNER = ("lost", "id")


def owner(row: str = "") -> Column:
    return F.struct(*[F.col(f"{row}{c}") for c in OWNER])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """lost (whether the id is null), id (0 if null), key (of the text and lost) and text."""
    own, text = F.col(name(id_col)).cast("bigint"), F.coalesce(F.col(name(text_col)), F.lit(""))
    return docs.select(own.isNull().alias("lost"), F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64(text, own.isNull()).alias("key"), text.alias("text"))


def named_segments(rows: DataFrame, window: int) -> DataFrame:
    """(lost, id, key, name, start, windows, digest) of each segment of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for lost, own, key, text in zip(batch["lost"], batch["id"], batch["key"], batch["text"], strict=True):
                hashes = word_hashes(utf8(text).split())
                name, start, count = segments(hashes, window)
                if len(name):
                    digest = range_digests(hashes, start, start + count + window - 1)
                    parts.append(pd.DataFrame({"lost": lost, "id": own, "key": key, "name": name.astype(np.int64), "start": start.astype(np.int32), "windows": count.astype(np.int32), "digest": digest.astype(np.int64)}))
            if parts:
                yield pd.concat(parts)

    return map_batches(rows, run, "lost boolean, id bigint, key bigint, name bigint, start int, windows int, digest bigint")


def words_of(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The word hashes of the wanted segments: (name, heavy, lost, id, key, start, windows, words)."""
    asked = wanted.groupBy("id", "key").agg(*[F.collect_list(c).alias(c) for c in ("name", "heavy", "start", "windows")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                hashes = word_hashes(utf8(r.text).split())
                for name, heavy, start, windows in zip(r.name, r.heavy, r.start, r.windows, strict=True):
                    out.append((name, heavy, r.lost, r.id, r.key, start, windows, hashes[start : start + windows + window - 1].tobytes()))
            yield pd.DataFrame(out, columns=["name", "heavy", "lost", "id", "key", "start", "windows", "words"])

    return map_batches(rows.join(asked, ["id", "key"]), run, "name bigint, heavy boolean, lost boolean, id bigint, key bigint, start int, windows int, words binary")


def shard_matches(shard: pd.DataFrame, window: int) -> pd.DataFrame:
    """(name, id, key, first, start, length): intervals of the segments of one shard that smaller documents cover; first is the segment's place."""
    words = [np.frombuffer(w, np.uint64) for w in shard["words"]]
    own, lost = shard["id"].to_numpy(np.int64), shard["lost"].to_numpy(bool)
    owners = np.unique(own, return_inverse=True)[1] + lost * (len(own) + 1)  # their places in the order of documents
    segment, offset = FMIndex(words, owners).covered(owners, shard["windows"].to_numpy(np.int64), window)
    fresh = np.concatenate([[True], (np.diff(segment) != 0) | (np.diff(offset) != 1)]) if len(segment) else np.empty(0, bool)
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(segment)))
    rows = shard.iloc[segment[first]]
    return pd.DataFrame({"name": rows["name"].to_numpy(), "id": rows["id"].to_numpy(), "key": rows["key"].to_numpy(), "first": rows["start"].to_numpy(), "start": (rows["start"].to_numpy() + offset[first]).astype(np.int32), "length": (count + window - 1).astype(np.int32)})


def window_digests(found: DataFrame, window: int) -> DataFrame:
    """(low, high, name, lost, id, key, first, start): 128 bits of digest of each window of each segment; first is the segment's place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                hashes = np.frombuffer(r.words, np.uint64)
                at = np.arange(r.windows)
                low, high = range_digests(hashes, at, at + window), range_digests(mixed(hashes), at, at + window)
                yield pd.DataFrame({"low": low.astype(np.int64), "high": high.astype(np.int64), "name": r.name, "lost": r.lost, "id": r.id, "key": r.key, "first": r.start, "start": (r.start + at).astype(np.int32)})

    return map_batches(found, run, "low bigint, high bigint, name bigint, lost boolean, id bigint, key bigint, first int, start int")


def repeated_intervals(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, key, start, length): word intervals that smaller documents cover; they may overlap."""
    every = written(named_segments(rows, window))
    shared = every.groupBy("name").agg(F.min(owner()).alias("low"), F.max(owner()).alias("high")).filter("low < high").select("name")
    near = written(join_unique(every, shared, ["name"], "left_semi"))
    distinct = written(near.groupBy("name", "digest", "windows").agg(F.min(F.struct(*OWNER, "key", "start")).alias("first")))
    counts = distinct.groupBy("name").agg(F.count(F.lit(1)).alias("distinct_segments")).filter("distinct_segments > 1")
    # every other place of a segment: in a larger document it goes whole; where the smallest document repeats it, it fares as the first
    placed = join_unique(near, distinct, ["name", "digest", "windows"]).withColumn("later", owner() > owner("first.")).filter("later or key <> first.key or start <> first.start")
    placed = written(placed.select("name", "id", "key", "start", "windows", "later", F.col("first.key").alias("first_key"), F.col("first.start").alias("first")))
    whole = placed.filter("later").select("id", "key", "start", (F.col("windows") + F.lit(window - 1)).alias("length"))

    wanted = join_unique(distinct, counts, ["name"]).select("name", (F.col("distinct_segments") > HEAVY).alias("heavy"), "first.id", "first.key", "first.start", "windows")
    found = written(words_of(rows, wanted, window).dropDuplicates(["name", "id", "key", "start"]))
    total = found.filter("not heavy").agg(F.sum(F.col("windows") + F.lit(window - 1))).first()[0] or 0
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_WORDS))
    dealt = found.filter("not heavy").withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)))
    matched = dealt.groupBy("shard").applyInPandas(lambda shard: shard_matches(shard, window), "name bigint, id bigint, key bigint, first int, start int, length int")

    windows = written(window_digests(found.filter("heavy"), window))
    earliest = windows.groupBy("low", "high").agg(F.min(owner()).alias("earliest"))
    heavy = join_unique(windows, earliest, ["low", "high"]).filter(owner() > F.col("earliest")).select("name", "id", "key", "first", "start", F.lit(window).alias("length"))
    hits = written(matched.unionByName(heavy))
    again = placed.filter("not later").select("name", "id", F.col("first_key").alias("key"), "first", F.col("key").alias("own_key"), F.col("start").alias("place")).distinct()
    repeated = hits.join(again, ["name", "id", "key", "first"]).select("id", F.col("own_key").alias("key"), (F.col("start") - F.col("first") + F.col("place")).alias("start"), "length")
    return whole.unionByName(hits.select("id", "key", "start", "length")).unionByName(repeated)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_removed, kept_sha256 and the kept text."""
    rows = keyed(docs, id_col, text_col)
    intervals = repeated_intervals(rows, window)
    marks = written(intervals.groupBy("id", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own, text, starts, lengths in zip(batch["id"], batch["text"], batch["starts"], batch["lengths"], strict=True):
                words = utf8(text).split()
                n = len(words)
                if starts is not None:
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, np.asarray(starts, np.int64), 1)
                    np.add.at(edge, np.asarray(starts, np.int64) + np.asarray(lengths, np.int64), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                kept = b" ".join(words)
                out.append((own, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = rows.join(marks, ["id", "key"], "left").select(F.when(~F.col("lost"), F.col("id")).alias("id"), "text", "starts", "lengths")
    return map_with_id(joined, run, "n_words bigint, n_removed bigint, kept_sha256 string, kept string").withColumnRenamed("id", id_col)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op9_substrings": op9_substrings}
SQL = {
    "op9_substrings": r"""
        WITH tokens AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT doc_id, pos, hash(array_to_string(words[pos:pos + 49], ' ')) AS h1, hash(array_to_string(words[pos:pos + 49], '_')) AS h2
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM tokens WHERE len(words) >= 50)
        ), repeated AS (
            SELECT doc_id, pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY h1, h2) AS earliest FROM windows) WHERE doc_id > earliest
        ), removed AS (
            SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS place FROM repeated
        ), places AS (
            SELECT doc_id, len(words) AS n, words, unnest(CASE WHEN len(words) = 0 THEN [0::BIGINT] ELSE range(1, len(words) + 1) END) AS place FROM tokens
        )
        SELECT doc_id, n::BIGINT AS n_words, count(r.place)::BIGINT AS n_removed,
               sha256(coalesce(string_agg(words[place], ' ' ORDER BY place) FILTER (r.place IS NULL AND place > 0), '')) AS kept_sha256
        FROM places p LEFT JOIN removed r USING (doc_id, place) GROUP BY doc_id, n
    """
}
