"""Strict readers of event logs, ragged CSV files and JSON documents: every fault is a row, nothing is dropped in silence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import LOG, log, read
from .staging import staged

EVENT = "seq bigint, mono_us bigint, utc_us bigint, ev string, data string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of all lines of text files, numbered from 1 in each file, however large a file is.

    Spark reads a file by blocks. A line's place in its block is counted as the block is read; how many lines the blocks before it have is counted
    by a second read, of which only a row for each block moves.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n = None, 0
        for batch in batches:
            numbers = []
            for own in zip(batch["file"], batch["block"], strict=True):
                at, n = own, n + 1 if own == at else 1
                numbers.append(n)
            yield batch.assign(place=pd.Series(numbers, batch.index, dtype="int64"))

    blocks = text.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    lines = text.mapInPandas(placed, "file string, block bigint, value string, place bigint")
    return lines.join(before, ["file", "block"]).select("file", (F.col("before") + F.col("place")).alias("line"), "value")


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, seq, mono_us, utc_us, ev, data, fault) of JSONL logs; blank lines are skipped, others that are not an event carry a fault."""
    rows = numbered_lines(spark, path).filter(F.trim("value") != "").withColumn("event", F.from_json("value", EVENT))
    sound = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"\A\s*\{") & F.col("event.ev").isNotNull() & F.col("event.seq").isNotNull()
    return rows.select("file", "line", "event.*", F.when(~F.coalesce(sound, F.lit(False)), "not_an_event").alias("fault"))


def merged_sessions(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The events of all logs whose file name matches, in order of time, then file and line; lines that are no events are left to ``event_lines``."""
    events = event_lines(spark, path).filter(F.element_at(F.split("file", "/"), -1).rlike(rf"\A(?:{pattern})\z"))
    return events.filter("fault is null").drop("fault").orderBy("utc_us", "file", "line")


def sampler(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, line, sample): the first line of each file is the header of all the others."""
    lines = numbered_lines(spark, path)
    heads = lines.filter("line = 1").select("file", F.col("value").alias("header"))
    return lines.filter("line > 1").filter(F.trim("value") != "").join(heads, "file").select("file", "header", F.col("line") - 1, F.col("value").alias("sample")).toDF("file", "header", "line", "sample")


def quoted_cells(line: Column) -> Column:
    """The cells of a CSV line, without their quotes."""
    quoted = r'"[^"]*+(?:""[^"]*+)*+"'
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf",({quoted}(?=,|\z)|[^,]*)"), 1)
    return F.transform(raw, lambda c: F.when(c.rlike(rf"\A{quoted}\z"), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def ragged_csv(spark: SparkSession, path: str, header: list[str], widths: tuple[int, ...]) -> DataFrame:
    """(file, row, cells, fault): cells of rows whose width is allowed; a wrong header or width is a fault of its row.

    A cell may stand in double quotes, and then hold commas and doubled quotes, but no line ends.
    """
    lines = numbered_lines(spark, path).filter(F.col("value") != "")
    cells = lines.select("file", (F.col("line") - 1).alias("row"), quoted_cells(F.col("value")).alias("cells"))
    names = F.when(F.size(F.array_distinct("cells")) < F.size("cells"), "repeated_header").when(F.array_join("cells", ",") != ",".join(header), "wrong_header")
    wrong = F.when(F.col("row") == 0, names).when(~F.size("cells").isin(*widths), "wrong_width")
    return cells.select("file", "row", "cells", wrong.alias("fault"))


def number(column: str) -> Column:
    """A tolerant number: null where the text is missing or no number."""
    return F.expr(f"try_cast(`{column}` AS double)")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, document, fault): parsed whole documents; not valid strict JSON (duplicate keys, NaN) is a fault."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = text.withColumn("document", F.try_parse_json("value"))
    fault = F.when(F.col("value").startswith("﻿"), "byte_order_mark").when(F.col("document").isNull(), "not_strict_json")
    return parsed.select("file", "document", fault.alias("fault"))


def metrics(spark: SparkSession, path: str, stamp: str, since: float, until: float) -> DataFrame:
    """Headered CSV series whose clock starts at the epoch in the file name (digits before .csv), clipped to a window."""
    rows = spark.read.option("header", True).csv(path).withColumn("file", F.col("_metadata.file_name"))
    start = F.regexp_extract("file", r"([0-9]+)\.csv$", 1).cast("double")
    return rows.withColumn("t", start + F.expr(f"try_cast(`{stamp}` AS double)") / 1000).filter(F.col("t").between(since, until))


def file_duplicates(df: DataFrame, phase: str, number_: str) -> DataFrame:
    """Adds taken_twice: whether another row of the phase has the same number."""
    return df.withColumn("taken_twice", F.count(F.lit(1)).over(Window.partitionBy(phase, number_)) > 1)


def staged_log(spark: SparkSession, sf_dir: str) -> str:
    """The event log as JSONL files, a folder's worth; small values are written as lines that are no events, negative ones as blank lines."""
    event = F.to_json(F.struct("seq", F.col("utc_us").alias("mono_us"), "utc_us", "ev", F.struct("k", "session").alias("data")))
    line = F.when(F.col("value") < 0, "  ").when(F.col("value") < 5, F.concat(F.lit("["), "seq", F.lit("]"))).when(F.col("value") < 10, F.concat(F.lit('{"seq": '), "seq")).otherwise(event)
    path = staged(spark, "log")
    log(spark, sf_dir).repartition("session").sortWithinPartitions("session", "seq").select(line.alias("value")).write.text(path)
    return path


def q_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of the log's files finds: events by kind, and faults, with sums that every line must enter."""
    found = event_lines(spark, staged_log(spark, sf_dir))
    return found.groupBy(F.coalesce("ev", F.lit("?")).alias("ev"), F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("fault").isNull(), F.col("seq"))).alias("seqs"), F.sum(F.when(F.col("fault").isNull(), F.get_json_object("data", "$.k").cast("bigint"))).alias("ks"))


def q_merged_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clicks of all files in order of time."""
    events = merged_sessions(spark, staged_log(spark, sf_dir), r"part-.*").filter("ev = 'click'")
    return events.select("ev", "seq", "utc_us", F.get_json_object("data", "$.session").cast("bigint").alias("session"))


def q_ragged_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as CSV files of two widths and some others, with quoted cells, read back: widths, faults and what the cells hold."""
    items = read(spark, sf_dir, "lineitem")
    quoted = F.concat(F.lit('"'), "l_returnflag", F.lit(',""'), "l_linestatus", F.lit('"""'))
    wide = F.concat_ws(",", "l_orderkey", "l_linenumber", quoted, "l_partkey", "l_suppkey")
    row = F.when(F.col("l_discount") < 0.05, F.concat_ws(",", "l_orderkey", "l_linenumber", quoted)).when(F.col("l_discount") < 0.1, wide).otherwise(F.concat_ws(",", "l_orderkey", quoted))
    path = staged(spark, "items")
    items.select(row.alias("value")).write.text(path)
    header = ["order", "line", "flags", "part", "supplier"]
    found = ragged_csv(spark, path, header, (3, 5)).withColumn("fault", F.when(F.col("row") == 0, F.when(~F.size("cells").isin(3, 5), "wrong_width")).otherwise(F.col("fault")))
    return found.groupBy(F.size("cells").alias("width"), F.coalesce("fault", F.lit("none")).alias("fault"), F.element_at("cells", F.when(F.size("cells") == 2, 2).otherwise(3)).alias("flags")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.element_at("cells", 1).cast("bigint")).alias("orders"))


QUERIES = {"event_files": q_event_lines, "merged_sessions": q_merged_sessions, "ragged_files": q_ragged_csv}
SQL = {
    "event_files": f"""
        WITH {LOG}, told AS (SELECT CASE WHEN value >= 10 OR value IS NULL THEN ev ELSE '?' END AS ev, CASE WHEN value >= 10 OR value IS NULL THEN 'none' ELSE 'not_an_event' END AS fault, seq, k FROM log WHERE value >= 0 OR value IS NULL)
        SELECT CASE WHEN fault = 'none' THEN ev ELSE '?' END AS ev, fault, count(*) AS n, sum(CASE WHEN fault = 'none' THEN seq END)::BIGINT AS seqs, sum(CASE WHEN fault = 'none' THEN k END)::BIGINT AS ks FROM told GROUP BY ALL
    """,
    "merged_sessions": f"WITH {LOG} SELECT ev, seq, utc_us, session FROM log WHERE (value >= 10 OR value IS NULL) AND ev = 'click'",
    "ragged_files": """
        SELECT CASE WHEN l_discount < 0.05 THEN 3 WHEN l_discount < 0.1 THEN 5 ELSE 2 END AS width, CASE WHEN l_discount < 0.1 THEN 'none' ELSE 'wrong_width' END AS fault, l_returnflag || ',"' || l_linestatus || '"' AS flags, count(*) AS n, sum(l_orderkey)::BIGINT AS orders
        FROM lineitem GROUP BY ALL
    """,
}
