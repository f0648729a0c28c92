"""Strict JSON documents: every reason why one does not parse is a row with its place, over any number of files at once.

Edge cases: an empty file is ``E_PARSE_JSON``. A document that holds the value null parses. Null contents are unreadable (``E_PARSE_ENCODING``). Repeated files give repeated
rows. Whole files are rows, so a file must fit one (2 GB).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = b"\xef\xbb\xbf"


class Fault(ValueError):
    """A fault of a value, with its code."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def _object(pairs: list[tuple]) -> dict:
    whole = dict(pairs)
    if len(whole) < len(pairs):
        met: set[str] = set()
        twice = next(k for k, _ in pairs if k in met or met.add(k))
        raise Fault("E_PARSE_DUPLICATE_KEY", f"key {twice!r} appears twice in one object")
    return whole


def _number(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise Fault("E_NONFINITE", f"{text} is too large for a double")
    return value


def _word(text: str) -> float:
    raise Fault("E_NONFINITE", f"{text} is not a JSON number")


DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_float=_number, parse_constant=_word)


def fault_of(data: bytes | None) -> tuple[str | None, str | None]:
    """(code, message) of the first fault of a document; (None, None) if it parses."""
    if data is None:
        return "E_PARSE_ENCODING", "there is nothing to read"
    if data.startswith(MARK):
        return "E_PARSE_ENCODING", "starts with a UTF-8 byte-order mark"
    try:
        DECODER.decode(data.decode())
    except UnicodeDecodeError as e:
        return "E_PARSE_ENCODING", f"not UTF-8 at byte {e.start}"
    except json.JSONDecodeError as e:
        return "E_PARSE_JSON", f"{e.msg} at line {e.lineno}, column {e.colno}"
    except Fault as e:
        return e.code, str(e)
    except RecursionError:
        return "E_PARSE_JSON", "nested too deeply"
    return None, None


def parsed(documents: DataFrame) -> DataFrame:
    """``documents`` (file, content as bytes) as (file, document, code, message); ``document`` is the text, null where there is a fault."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            faults = [fault_of(None if x is None else bytes(x)) for x in batch["content"]]
            texts = [None if f[0] else bytes(x).decode() for f, x in zip(faults, batch["content"], strict=True)]
            yield pd.DataFrame({"file": batch["file"], "document": texts, "code": [f[0] for f in faults], "message": [f[1] for f in faults]})

    return documents.select("file", "content").mapInPandas(run, "file string, document string, code string, message string")


def documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The documents of all files at or below a path, with their faults."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "content"))


def issues(documents: DataFrame, *layers) -> DataFrame:
    """(file, path, code, message): the parse faults, and those that each layer finds in the documents that parse.

    A layer takes the sound documents (file, document) and returns rows of this shape; documents with a fault are left out before.
    """
    sound = documents.filter("code is null").select("file", "document")
    out = documents.filter("code is not null").select("file", F.lit("$").alias("path"), "code", "message")
    for layer in layers:
        out = out.unionByName(layer(sound))
    return out
