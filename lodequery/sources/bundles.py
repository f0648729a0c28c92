"""Verification of published folders: files against their list, and one hash for a whole tree, by levels.

Files are read by Spark's binary source and hashed where they are; only names, sizes and hashes move. A file must fit a row (2 GB).

Spark's file sources do not list empty files: a listed file of no bytes with the hash of the empty text is taken as there, and
empty files take no part in a tree's hash.

Edge cases: a list may name a file twice (``listed_twice``); names are relative, with ``/`` between parts. Null names or hashes in a list are ``unusable_entry``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, sha256) of all files below a folder."""
    root = folder.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    return found.select(F.substr(bare(F.col("path")), F.length(bare(F.lit(root))) + 2).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


#: SHA-256 of no bytes.
NOTHING = hashlib.sha256(b"").hexdigest()


def file_faults(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(name, fault) of files that the list (name, size, sha256) and the folder do not agree on: missing, extra, size, content, listed_twice or unusable_entry."""
    usable = F.col("name").isNotNull() & F.col("sha256").isNotNull()
    once = listed.filter(usable).groupBy("name").agg(F.count(F.lit(1)).alias("_times"), F.max("size").alias("_size"), F.max("sha256").alias("_sha256"))
    both = once.join(found.select("name", "size", "sha256"), "name", "full_outer")
    fault = (
        F.when(F.col("_times").isNull(), "extra").when(F.col("_times") > 1, "listed_twice").when(F.col("sha256").isNull() & (F.coalesce("_size", F.lit(-1)) == 0) & (F.lower("_sha256") == NOTHING), None).when(F.col("sha256").isNull(), "missing")
        .when(F.col("_size") != F.col("size"), "size").when(F.lower("_sha256") != F.col("sha256"), "content")
    )
    unusable = listed.filter(~usable).select("name", F.lit("unusable_entry").alias("fault"))
    return both.select("name", fault.alias("fault")).filter("fault is not null").unionByName(unusable)


def tree_hashes(found: DataFrame) -> DataFrame:
    """(folder, level, entries, sha256) of every folder of a tree of files (name, sha256): the hash of its entries' lines ``kind sha256 name``, sorted by name.

    A level at a time from the deepest; the driver learns the depth only.
    """
    parts = found.select(F.split("name", "/").alias("parts"), F.col("sha256"))
    based = parts.select(F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/").alias("folder"), F.element_at("parts", -1).alias("entry"), (F.size("parts") - 1).alias("level"), F.lit("file").alias("kind"), "sha256")
    deepest = based.agg(F.max("level")).first()[0] or 0
    done, above = None, None
    for level in range(deepest, -1, -1):
        here = based.filter(F.col("level") == level)
        here = here if above is None else here.unionByName(above)
        line = F.concat_ws(" ", "kind", "sha256", "entry")
        hashed = here.groupBy("folder").agg(F.count(F.lit(1)).alias("entries"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry", line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("sha256"))
        level_rows = hashed.select("folder", F.lit(level).alias("level"), "entries", "sha256")
        done = level_rows if done is None else done.unionByName(level_rows)
        up = F.split("folder", "/")
        above = hashed.select(F.array_join(F.slice(up, F.lit(1), F.size(up) - 1), "/").alias("folder"), F.element_at(up, -1).alias("entry"), F.lit(level - 1).alias("level"), F.lit("folder").alias("kind"), "sha256")
    return done
