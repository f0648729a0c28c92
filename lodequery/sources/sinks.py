"""Sinks that can be trusted: a table published only when it reads back equal, and a stream written batch by batch with a ledger.

``publish`` writes to a staging folder beside the target, reads it back, compares the number and two sums of hashes of its rows with what was observed while
writing, and renames the folder. An existing target is refused; after a failure nothing is left.

``append_batches`` writes each micro-batch of a stream to a folder of its own and then enters it in a ledger, whose entry appears by
a rename. A batch that is entered is never written again; what a killed run left of a batch without an entry is removed when the batch comes again. ``committed`` reads
entered batches only, so a reader never sees a partial tail, and ``ledger_faults`` holds the folders against the ledger.

Edge cases: an empty table or batch is published or entered with no rows. Columns of any type take part in the hashes, maps and variants by their JSON. Rows that
repeat count each. Renames are atomic on HDFS and local disks; on a store without renames the ledger's small file is what decides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

LEDGER = "batch bigint, n bigint, total string, mixed bigint"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = file_system(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    system, place = file_system(spark, path)
    system.delete(place, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    system, place = file_system(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    if system.exists(target) or not system.rename(place, target):
        raise FileExistsError(f"{path} could not be renamed to {to}")


def _plain(field: T.StructField) -> Column:
    """A column as it can be hashed."""
    column = F.col("`" + field.name.replace("`", "``") + "`")
    told = field.dataType.simpleString()
    return F.to_json(F.struct(column)) if "map<" in told or "variant" in told else column


def fingerprint(df: DataFrame) -> list[Column]:
    """Aggregates that tell tables apart whatever the order of their rows: n, a sum and an exclusive-or of row hashes."""
    row = F.xxhash64(F.lit(len(df.columns)), *[_plain(f) for f in df.schema.fields])
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("total"), F.coalesce(F.bit_xor(F.xxhash64(row)), F.lit(0)).cast("bigint").alias("mixed")]


def written(df: DataFrame, path: str) -> dict:
    """Write as Parquet and read back; the fingerprint that both passes agree on."""
    seen = Observation()
    df.observe(seen, *fingerprint(df)).write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    found, told = back.agg(*fingerprint(back)).first().asDict(), seen.get
    if {k: found[k] for k in told} != told:
        raise ValueError(f"{path} does not read back as written: {found}, not {told}")
    return found


def publish(df: DataFrame, path: str) -> dict:
    """Publish a table under a path that does not exist yet. Returns its fingerprint."""
    spark, path = df.sparkSession, path.rstrip("/")
    if exists(spark, path):
        raise FileExistsError(f"{path} exists; nothing is overwritten")
    parent, name = path.rsplit("/", 1)
    staging = f"{parent}/.{name}.partial-{uuid.uuid4().hex}"
    try:
        found = written(df, staging)
        move(spark, staging, path)
    except BaseException:
        remove(spark, staging)
        raise
    return found


def _entry(folder: str, batch: int) -> str:
    return f"{folder}/_ledger/{batch:012d}"


def append_batch(rows: DataFrame, batch: int, folder: str) -> bool:
    """Write a batch and enter it, unless it is entered. True if it was written now."""
    spark, data = rows.sparkSession, f"{folder}/batch={batch}"
    if exists(spark, _entry(folder, batch)):
        return False
    remove(spark, data)  # what a killed run left of it
    found = written(rows, data)
    staging = f"{folder}/_ledger/.partial-{uuid.uuid4().hex}"
    spark.createDataFrame([(batch, found["n"], found["total"], found["mixed"])], LEDGER).coalesce(1).write.json(staging)
    move(spark, staging, _entry(folder, batch))
    return True


def append_batches(stream: DataFrame, folder: str, checkpoint: str, before: Callable[[DataFrame, int], DataFrame] | None = None) -> DataStreamWriter:
    """A writer of a stream whose batches are appended each once. ``before`` may change the rows of a batch."""
    folder = folder.rstrip("/")

    def write(rows: DataFrame, batch: int) -> None:
        append_batch(before(rows, batch) if before else rows, batch, folder)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, n, total, mixed) of the entered batches."""
    entries = f"{folder.rstrip('/')}/_ledger"
    if not exists(spark, entries):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").json(f"{entries}/[0-9]*")


def committed(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of the entered batches, with their ``batch``."""
    entered = ledger(spark, folder).select("batch").distinct()
    typed = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(typed).option("basePath", folder).parquet(folder).join(F.broadcast(entered), "batch", "left_semi").select(*typed.fieldNames())


def ledger_faults(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """(batch, fault) of batches whose folder and entry differ: not_entered, missing or changed."""
    typed = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(typed).option("basePath", folder).parquet(folder)
    found = rows.groupBy("batch").agg(*[c.alias(f"found_{n}") for c, n in zip(fingerprint(rows.select(*schema.fieldNames())), ("n", "total", "mixed"), strict=True)])
    both = ledger(spark, folder).join(found, "batch", "full_outer")
    same = (F.col("n") == F.col("found_n")) & (F.col("total") == F.col("found_total")) & (F.col("mixed") == F.col("found_mixed"))
    fault = F.when(F.col("n").isNull(), "not_entered").when(F.col("found_n").isNull() & (F.col("n") > 0), "missing").when(F.col("found_n").isNotNull() & ~same, "changed")
    return both.select("batch", fault.alias("fault")).filter("fault is not null")
