"""Shared helpers of the corpus operators: inputs, durable tables, joins and hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Small sides up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000
#: Rows of an Arrow batch: keeps a Python worker's memory bounded when texts are long.
BATCH_ROWS = 512
#: Keys of fewer rows are never hot.
HOT_ROWS = 64

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def name(column: str) -> str:
    """A column's name as it can be written in an expression, whatever dots or backticks are in it."""
    return "`" + column.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct, so that their names cannot clash with others."""
    return F.struct(*[F.col(name(c)) for c in docs.columns])


def opened(rows: DataFrame, columns: list[str], row: str = "row") -> DataFrame:
    """The columns of a struct made by ``whole_row``."""
    return rows.select(*[F.col(row).getField(c).alias(c) for c in columns])


def delete(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Remove a folder of intermediate data, now or when the application ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_exit:
        system.deleteOnExit(place)
    else:
        system.delete(place, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only a local master may go without: it gets a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = getattr(spark, "_lodequery_shared", None) or tempfile.mkdtemp(prefix="lodequery-")
        spark._lodequery_shared = named
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
        delete(df.sparkSession, context.getCheckpointDir(), at_exit=True)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder (compressed, prunable, of known size)."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/lodequery-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete(df.sparkSession, path, at_exit=True)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """Join with a side that is expected to be small, whatever the skew of ``keys`` in ``big``.

    The small side is counted first: up to BROADCAST_ROWS it is broadcast; beyond, it is copied once
    for each of ``salts`` and joined by shuffle, so one key of ``big`` is dealt over ``salts`` tasks.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*keys, "_salt"], how).drop("_salt")


def hot_keys(big: DataFrame, key: list[str]) -> DataFrame | None:
    """The keys with more than a thousandth of the rows of ``big`` (and HOT_ROWS): fewer than a thousand. None if there is none."""
    counts = big.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    line = max((total or 0) / 1000, HOT_ROWS)
    return durable(counts.filter(F.col("_n") > line).select(*key).dropna()) if (most or 0) > line else None


def join_unique(big: DataFrame, side: DataFrame, key: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Join (inner, left or left_semi) with a side that has one row for each key, whatever the skew of the keys in ``big``.

    Rows of hot keys (``hot``, or those found by ``hot_keys``) are joined with their fewer than a thousand rows of
    ``side`` by broadcast, all others by shuffle. ``big`` is read several times: keep it cheap. Null keys match nothing.
    """
    hot = hot_keys(big, key) if hot is None else hot
    if hot is None:
        return big.join(side, key, how)
    marked = big.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    of_hot = F.broadcast(side.join(F.broadcast(hot), key, "left_semi"))
    dealt = marked.filter("_hot").drop("_hot").join(of_hot, key, how)
    return dealt.unionByName(marked.filter("_hot is null").drop("_hot").join(side, key, how))


def one_row_each(docs: DataFrame, id_col: str, text_col: str, digest: Column, winners: DataFrame) -> DataFrame:
    """For each (id, digest) of ``winners`` one row of ``docs``, all columns: the first by the other columns, then by the digest of its text.

    A row is carried in a struct, so neither the names nor the types of other columns matter. Rows that repeat id
    and digest are reduced before they move.
    """
    others = [F.col(name(c)) for c in docs.columns if c not in (id_col, text_col)]
    order = F.struct(F.to_json(F.struct(*others)) if others else F.lit(""), F.sha2(F.coalesce(F.col(name(text_col)), F.lit("")), 256))
    rows = docs.select(row_key(F.col(name(id_col)), digest).alias("key"), whole_row(docs).alias("row"), order.alias("order"))
    first = rows.groupBy("key").agg(F.min_by("row", "order").alias("row"))
    wanted = winners.select(row_key(F.col("id"), F.col("digest")).alias("key"))
    return opened(first.join(wanted, "key", "left_semi"), docs.columns)


def row_key(own: Column, digest: Column) -> Column:
    """One string for an id, which may be null, and a digest in hex."""
    return F.concat(F.when(own.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), own.cast("string"))), F.lit("|"), digest)


def map_batches(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | T.StructType) -> DataFrame:
    """mapInPandas in batches of bounded rows (their bytes are bounded by the session's maxBytesPerBatch, 64 MB unless set)."""
    bound_batches(df.sparkSession)
    return df.mapInPandas(function, schema)


def map_with_id(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``map_batches`` for rows whose ``id`` (a bigint) may be null: it travels as a string, as a column of numbers with nulls would lose digits.

    ``schema`` lists the columns after ``id``, which the function passes on as it is.
    """
    out = map_batches(df.withColumn("id", F.col("id").cast("string")), function, f"id string, {schema}")
    return out.withColumn("id", F.col("id").cast("bigint"))


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the rows of an Arrow batch to what a worker can hold; a lower one stays."""
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(option)) <= BATCH_ROWS:
        spark.conf.set(option, str(BATCH_ROWS))


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty, and what cannot be encoded becomes a question mark as in the JVM."""
    return b"" if text is None else text.encode("utf-8", "replace")
