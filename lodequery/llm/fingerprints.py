"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every five-word shingle is hashed once; the high bits choose its bin and the bin keeps the smallest
hash. An empty bin borrows from a bin drawn by a hash of (its number, attempt) until that bin is a filled
one, so two sets borrow alike. The low ``BITS`` of each bin are stored, packed to hex. The share of equal
bins, corrected for chance agreement 2**-BITS, estimates the Jaccard likeness of the shingle sets.

Edge cases: null is the empty text. A text of fewer than five words is one shingle of all its words;
without words the fingerprint is the empty string, which is like another empty one (1) and unlike all
others (0). The next document is the next lower id; rows that repeat an id follow each other by
the digest of their text; null ids come last. The only document is its own next. An empty table gives
an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_with_id, name, table, utf8

WIDTH, BINS, BITS = 5, 256, 8
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def donors(bins: int) -> np.ndarray:
    """For each attempt and bin the bin to borrow from; the same for all documents."""
    grid = np.arange(16 * bins, dtype=np.uint64)[:, None] * np.uint64(bins) + np.arange(bins, dtype=np.uint64)[None, :]
    return (mixed(grid * MULTIPLIER + MULTIPLIER) % np.uint64(bins)).astype(np.int64)


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words (of all words if there are fewer)."""
    words = utf8(text).split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    wide = min(width, len(words))
    total = np.zeros(len(words) - wide + 1, np.uint64)
    for k in range(wide):  # a polynomial in the word hashes keeps the order of words
        total = total * MULTIPLIER + own[k : len(own) - wide + 1 + k]
    return mixed(total)


def sketch(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> str:
    """Packed low-order bits of the densified bins, as hex; empty for an empty set."""
    if not len(hashes):
        return ""
    least = np.full(bins, np.uint64(2**64 - 1))
    place = (hashes >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
    value = hashes << np.uint64((bins - 1).bit_length())  # what the bin's number does not hold
    np.minimum.at(least, place, value)
    filled = np.zeros(bins, bool)
    filled[place] = True
    source = np.arange(bins)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        drawn = donors(bins)
        if len(empty) == bins - 1:
            source[empty] = np.flatnonzero(filled)[0]
            empty = empty[:0]
        for attempt in range(len(drawn)):
            if not len(empty):
                break
            give = drawn[attempt, empty]
            good = filled[give]
            source[empty[good]] = give[good]
            empty = empty[~good]
        source[empty] = np.flatnonzero(filled)[0]
    low = mixed(least[source]) & np.uint64((1 << bits) - 1)
    packed = np.packbits(((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8))
    return packed.tobytes().hex()


def likeness(one: str, other: str, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated Jaccard likeness of two packed fingerprints, corrected for chance agreement."""
    if not one or not other:
        return float(one == other)
    if bits == 8:
        same = float((np.frombuffer(bytes.fromhex(one), np.uint8) == np.frombuffer(bytes.fromhex(other), np.uint8)).mean())
        return min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))
    a, b = (np.unpackbits(np.frombuffer(bytes.fromhex(x), np.uint8)).reshape(bins, bits) for x in (one, other))
    same, chance = float((a == b).all(axis=1).mean()), 2.0**-bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def part_of(column: str, limits: list[int]) -> Column:
    """How many of the descending ``limits`` are not below the value: a search in two levels. Nulls come last."""
    if not limits:
        return F.lit(0)
    wide = max(1, round(len(limits) ** 0.5))
    every, coarse = F.array(*map(F.lit, limits)), F.array(*map(F.lit, limits[wide - 1 :: wide]))
    whole = F.size(F.filter(coarse, lambda x: x >= F.col(column))) * wide
    rest = F.size(F.filter(F.slice(every, whole + 1, F.lit(wide)), lambda x: x >= F.col(column)))
    return F.when(F.col(column).isNull(), F.lit(len(limits))).otherwise(whole + rest)


def with_guests(rows: DataFrame, ranges: int) -> DataFrame:
    """(part, guest, id, text): rows dealt into ranges of descending ids, and for each range, as a guest, the row that follows its last.

    The limits are approximate quantiles of the ids; they and the first id of each range, ``ranges`` of
    either at most, are all that reaches the driver.
    """
    spark = rows.sparkSession
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.select("id").approxQuantile("id", shares, 0.2 / ranges) if shares else []
    dealt = rows.withColumn("part", part_of("id", sorted({min(int(x), 2**63 - 1) for x in found}, reverse=True)))
    heads = [(r["part"], r["head"]) for r in dealt.groupBy("part").agg(F.max("id").alias("head")).orderBy("part").collect()]
    if not heads:
        return dealt.select("part", F.lit(0).alias("guest"), "id", "text")
    followers = [(part, heads[(i + 1) % len(heads)][1]) for i, (part, _) in enumerate(heads)]
    asked = F.broadcast(spark.createDataFrame(followers, "host int, head bigint"))
    guests = dealt.join(asked, dealt["id"].eqNullSafe(asked["head"])).select(F.col("host").alias("part"), F.lit(1).alias("guest"), "id", "text")
    return dealt.select("part", F.lit(0).alias("guest"), "id", "text").unionByName(guests)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: fingerprints of the text and of its edited form, and their likeness.

    The edited text ends in the start of the next document. Rows are shuffled once, by ranges of ids, and
    streamed in order, so a task holds two texts at a time whatever the size of its range.
    """
    rows = docs.select(F.col(name(id_col)).cast("bigint").alias("id"), F.coalesce(F.col(name(text_col)), F.lit("")).alias("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = with_guests(rows, 4 * partitions).repartition(partitions, "part")
    ordered = ranged.sortWithinPartitions("part", "guest", F.desc_nulls_last("id"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None  # id, text and fingerprint of the row that waits for its successor
        for batch in batches:
            out = []
            for guest, own, text in zip(batch["guest"], batch["id"], batch["text"], strict=True):
                if guest and before is None:
                    continue
                mark = sketch(shingle_hashes(text))
                if before is not None:
                    was, old, its = before
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    new = its if edited == old else sketch(shingle_hashes(edited))
                    out.append((was, len(old), hashlib.sha256(utf8(edited)).hexdigest(), its, new, likeness(its, new), likeness(its, mark)))
                before = None if guest else (own, text, mark)
            yield pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_with_id(ordered, run, schema).withColumnRenamed("id", id_col)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op5_fingerprints": op5_fingerprints}
SQL: dict[str, str] = {}
