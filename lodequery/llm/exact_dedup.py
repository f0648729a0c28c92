"""Exact deduplication: tree-merge of sorted digest runs, with DataFrame functions only.

Rows are dealt into runs by a hash of their id. A run holds one entry for each distinct digest: the identifier that
stays and the number of rows. Runs then exchange entries in binomial rounds: the number of a run is written in digits
of base ``FAN``, and in round k the ``FAN`` runs that differ in digit k alone swap entries, so that each keeps those
whose digest has its digit. Every run is sorted by digest and by falling identifier, and what a run receives is merged
in that order, ``FAN`` entries of a digest at most: the first has the identifier that stays, the counts add up. After the last
round a digest is in one place, and a run is as large as at the start or smaller, so no task holds more than a run.

Each level verifies what it merges: entries of one SHA-256 must agree in the text's length and in a second,
unrelated 64-bit hash of it, or the query fails. The decision goes back to the entries of the first level, and from those to
the rows of each run: a group with a third of all rows is dealt over all runs there.

Edge cases: a null text equals the empty text. A null id loses against every other id. Rows that
repeat both id and text are one record: all get the same ``keep_id``, each counts in ``group_size``,
and only one of them has ``kept``. An empty table gives an empty result. Columns of the input other
than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, durable, name, one_row_each, table

FAN_BITS = 3
FAN = 1 << FAN_BITS


def digest_runs(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """id, run, digest, size and check of each row: the only pass over the texts."""
    text = docs.select(F.col(name(id_col)).alias("id"), ascii_lower(F.col(name(text_col))).alias("text"))
    return text.select(
        "id",
        F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int").alias("run"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").cast("long").alias("size"),
        F.xxhash64("text").alias("check"),
    )


def verified(low: str, high: str) -> Column:
    """``low`` if it equals ``high``; else two texts have one digest and the query fails."""
    return F.when(F.col(low) == F.col(high), F.col(low)).otherwise(F.raise_error(F.lit("two texts of one SHA-256")).cast("long"))


def first_runs(rows: DataFrame) -> DataFrame:
    """One entry for each run and digest, combined before rows move."""
    entries = rows.groupBy("run", "digest").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("size").alias("size"), F.max("size").alias("_size"), F.min("check").alias("check"), F.max("check").alias("_check")
    )
    return entries.select("run", "digest", "keep_id", "group_size", verified("size", "_size").alias("size"), verified("check", "_check").alias("check"))


def merge_round(entries: DataFrame, digit: int, runs: int) -> DataFrame:
    """Runs that differ in one digit swap entries and merge what they receive, in the order of digest and falling identifier."""
    shift = FAN_BITS * digit
    of_run, of_digest = (F.shiftright(x, shift).bitwiseAND(F.lit(FAN - 1)) for x in (F.col("run"), F.pmod(F.xxhash64("digest"), F.lit(runs)).cast("int")))
    moved = entries.withColumn("run", F.col("run") + F.shiftleft(of_digest - of_run, shift)).repartition("run")
    order = Window.partitionBy("run", "digest").orderBy(F.desc_nulls_last("keep_id"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = moved.select(
        "run", "digest", "keep_id", F.sum("group_size").over(whole).alias("group_size"), F.row_number().over(order).alias("place"),
        *[f(c).over(whole).alias(n) for c in ("size", "check") for f, n in ((F.min, c), (F.max, f"_{c}"))],
    )
    return seen.filter("place = 1").select("run", "digest", "keep_id", "group_size", verified("size", "_size").alias("size"), verified("check", "_check").alias("check"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_runs: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; the largest id of a group stays. There are as many runs as
    the first power of ``FAN`` that reaches ``least_runs``, the session's shuffle partitions if not given.
    """
    least_runs = least_runs or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = 1
    while FAN**rounds < least_runs:
        rounds += 1
    rows = durable(digest_runs(docs, id_col, text_col, FAN**rounds))
    first = durable(first_runs(rows))
    level = first
    for digit in range(rounds):
        level = merge_round(level, digit, FAN**rounds)
    decided = first.select("run", "digest").join(level.select("digest", "keep_id", "group_size"), "digest")
    repeats = Window.partitionBy("run", "digest", "id").orderBy("id")
    return (
        rows.join(decided, ["run", "digest"])
        .withColumn("repeat", F.row_number().over(repeats))
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("repeat") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows that repeat id and text, the first by the other columns."""
    verdict = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(name(id_col)).alias("id"), F.col("text_sha256").alias("digest"))
    return one_row_each(docs, id_col, text_col, F.sha2(ascii_lower(F.col(name(text_col))), 256), verdict)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op1_exact_dedup": """
        WITH keyed AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        ), grouped AS (
            SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM keyed GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM keyed JOIN grouped USING (text_sha256)
    """
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
