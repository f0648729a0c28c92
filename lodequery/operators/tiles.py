"""Pairs of a group's rows in numpy, tile by tile: no row is made for a pair, and none is shuffled.

A group's rows are dealt into tiles of about ``size`` by a hash of their ids, and each tile meets all columns of its group, which are sent to it in order of
their ids. A tile is worked through by one task, however large its group is; a task holds one tile with its group's columns and what ``step`` makes of a slice of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a tile, cells of a slice (what numpy works on at once, so that it stays in a core's cache), and the most partitions of the exchange.
ROWS, CELLS, MOST_PARTITIONS = 1024, 1 << 16, 4096


def tiled(rows: DataFrame, columns: DataFrame, key: str, id_: str, step: Callable[[object, pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, size: int = ROWS) -> DataFrame:
    """What ``step(key, tile's rows, group's columns)`` yields over all tiles. Rows and columns without a key meet none; a name that both have is of one type."""
    sizes = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_tiles"))
    tiles = sizes.agg(F.sum("_tiles")).first()[0] or 1
    own = rows.join(sizes, key).withColumn("_tile", F.pmod(F.xxhash64(id_), "_tiles").cast("int")).withColumn("_side", F.lit(1)).drop("_tiles")
    other = columns.join(sizes, key).withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).withColumn("_side", F.lit(0)).drop("_tiles")
    whole = other.unionByName(own, allowMissingColumns=True)
    row_names, column_names = rows.columns, columns.columns

    def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        n = int((table.column("_side").to_numpy() == 0).sum())
        if n < len(table):
            yield from step(table.column(key)[0].as_py(), table.slice(n).select(row_names), table.slice(0, n).select(column_names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            if not len(batch):
                continue
            k, t = batch.column(batch.schema.names.index(key)), batch.column(batch.schema.names.index("_tile"))
            codes, tile = k.dictionary_encode().indices.to_numpy(), t.to_numpy()
            marks = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(tile) != 0)) + 1).tolist(), len(batch)]
            for low, high in zip(marks, marks[1:]):
                head = (k[low].as_py(), int(tile[low]))
                if head != at and held:
                    yield from told(held)
                    held = []
                at = head
                held.append(batch.slice(low, high - low))
        if held:
            yield from told(held)

    dealt = whole.repartition(min(int(tiles), MOST_PARTITIONS), key, "_tile").sortWithinPartitions(key, "_tile", "_side", id_)
    return dealt.mapInArrow(run, schema)


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as doubles, null as nan."""
    return [table.column(n).to_numpy().astype(float) for n in names]


def known(table: pa.Table, *names: str) -> np.ndarray:
    """Rows in which none of these is null."""
    out = np.ones(len(table), bool)
    for n in names:
        out &= table.column(n).is_valid().to_numpy()
    return out


def texts(letters: np.ndarray) -> pa.Array:
    """Each row of a matrix of ASCII codes as one string."""
    n, m = letters.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * m), pa.py_buffer(np.ascontiguousarray(letters)))


def slices(n: int, m: int, cells: int = CELLS) -> Iterator[slice]:
    """The n rows of a matrix with m columns, in slices of about so many cells."""
    step = max(1, cells // max(m, 1))
    return (slice(i, min(n, i + step)) for i in range(0, n, step))
