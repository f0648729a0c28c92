"""SimHash near-deduplication: segment-popcount embedding, grid range-join under Manhattan distance, exact verification.

A fingerprint is embedded as the number of set bits of each of its 16 four-bit segments. The Manhattan
distance of two embeddings is never above the Hamming distance of the fingerprints, so fingerprints
at two or fewer differing bits lie within distance two on the grid of embeddings, and then some grid
cell is within distance one of both. Each distinct fingerprint is therefore entered in its own cell
and the (at most 32) adjacent ones; cells with a single fingerprint are dropped. What is left is verified exactly: inside
a cell, a fingerprint reaches the bit patterns of that cell at one bit or none from it, and two
fingerprints link if and only if they reach a common pattern. A pattern is reached by at most 65
fingerprints, which all link to each other, so each is tied to the smallest of them: no pairs within a
group are made, and nothing grows with the square of a group.

Edge cases: null is the empty text; a text without words has fingerprint zero and links like any
other; with fewer words than a shingle the whole word sequence is the one shingle. Rows that repeat
an id each get a row. Null ids are ignored in the minimum (a component of only null ids has a null
component_id). An empty table gives an empty result. The fingerprint of a third of all rows and the root of a large
component are joined by broadcast (``join_unique``), all others by shuffle. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, join_unique, map_with_id, name, one_row_each, table, utf8
from .components import connected_components

SEED = 42
SEGMENT_BITS = 4
SEGMENTS = 64 // SEGMENT_BITS
COUNT_BITS = 3  # a count of 0..4
#: Shingles hashed at a time: bounds the memory of one very long text.
PIECE = 1 << 18


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Space-joined runs of ``width`` words, repeats included; the whole sequence if it is shorter."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    begin, end = starts[: len(words) - width + 1].tolist(), (starts[width:] - 1).tolist()
    return [joined[a:b] for a, b in zip(begin, end, strict=True)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a whole text, unsigned."""
    pieces = shingles(utf8(text).lower().split(), width)  # bytes.lower and bytes.split know ASCII only
    ones = np.zeros(64, np.int64)
    for at in range(0, len(pieces), PIECE):
        part = pieces[at : at + PIECE]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(pieces), bitorder="little").view("<u8")[0])


def text_digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(name(text_col)), F.lit("")), 256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, digests: bool = False) -> DataFrame:
    """id and fp (the fingerprint as a signed long); with ``digests`` also the text's SHA-256."""
    extra = ["sha"] if digests else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in batch["text"]], np.uint64).astype(np.int64)
            yield batch[["id", *extra]].assign(fp=prints)[["id", "fp", *extra]]

    read = docs.select(F.col(name(id_col)).cast("bigint").alias("id"), F.col(name(text_col)).alias("text"), *[text_digest(text_col).alias(c) for c in extra])
    return map_with_id(read, run, "fp bigint" + "".join(f", {c} binary" for c in extra))


def grid_entries(prints: DataFrame) -> DataFrame:
    """(fp, step, cell): the fingerprint's own cell (step -1) and the cells at Manhattan distance one.

    Step 2s adds one to the count of segment s and step 2s + 1 takes one away. A cell packs the counts.
    """
    mask = (1 << SEGMENT_BITS) - 1
    count = [F.bit_count(F.shiftrightunsigned("fp", SEGMENT_BITS * s).bitwiseAND(F.lit(mask))).cast("long") for s in range(SEGMENTS)]
    own = sum((F.shiftleft(count[s], COUNT_BITS * s) for s in range(1, SEGMENTS)), count[0])
    step = lambda code, cell, exists: F.when(exists, F.struct(F.lit(code).alias("step"), cell.alias("cell")))
    cells = [F.struct(F.lit(-1).alias("step"), F.col("own").alias("cell"))]
    for s in range(SEGMENTS):
        unit = F.lit(1 << COUNT_BITS * s).cast("long")
        cells.append(step(2 * s, F.col("own") + unit, count[s] < SEGMENT_BITS))
        cells.append(step(2 * s + 1, F.col("own") - unit, count[s] > 0))
    return prints.withColumn("own", own).select("fp", F.explode(F.array_compact(F.array(*cells))).alias("entry")).select("fp", "entry.step", "entry.cell")


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that tie each fingerprint to the smallest one with which it shares a pattern; a < b.

    The closure of these links is the closure of all pairs at two or fewer differing bits, and of no other distance.
    """
    entries = grid_entries(prints)
    crowded = entries.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("cell")
    near = entries.join(crowded, "cell", "left_semi")
    bit = lambda j: F.expr(f"shiftleft(1L, {SEGMENT_BITS} * int(step / 2) + {j})")
    wanted = F.when(F.col("step") % 2 == 0, F.lit(0)).otherwise(F.lit(1))  # add a bit where there is none, take one where there is
    flips = [F.when(F.col("fp").bitwiseAND(bit(j)).cast("boolean").cast("int") == wanted, F.col("fp").bitwiseXOR(bit(j))) for j in range(SEGMENT_BITS)]
    reached = F.when(F.col("step") < 0, F.array("fp")).otherwise(F.array_compact(F.array(*flips)))
    stars = near.select("fp", F.explode(reached).alias("pattern")).groupBy("pattern").agg(F.collect_list("fp").alias("members")).filter("size(members) > 1")
    pairs = stars.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a < b")
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def rooted(docs: DataFrame, id_col: str, text_col: str, width: int = 3, digests: bool = False) -> DataFrame:
    """One row for each row of ``docs``: the columns of ``fingerprints``, component_id (smallest id reachable) and root, which names the component."""
    rows = durable(fingerprints(docs, id_col, text_col, width, digests))
    prints = durable(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(links(prints.select("fp")))
    owned = durable(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    return join_unique(rows, join_unique(owned, least, ["root"]).select("fp", "component_id", "root"), ["fp"])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row for each row of ``docs``: id, fp, fingerprint (hex), component_id (smallest id reachable)."""
    return rooted(docs, id_col, text_col, width).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, all columns: that with the smallest id (null only if all are), whatever ids other components have.

    Of texts of one component that share that id the one of the smallest digest stays; of rows that repeat it, the first by the other columns.
    """
    least = rooted(docs, id_col, text_col, digests=True).filter(F.col("id").eqNullSafe(F.col("component_id")))
    winners = least.groupBy("root").agg(F.min(F.struct("sha", "id")).alias("won")).select("won.id", F.lower(F.hex("won.sha")).alias("digest"))
    return one_row_each(docs, id_col, text_col, F.sha2(F.coalesce(F.col(name(text_col)), F.lit("")), 256), winners)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("fp")


QUERIES = {"op3_simhash": op3_simhash}
SQL: dict[str, str] = {}
