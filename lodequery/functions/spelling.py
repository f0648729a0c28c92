"""Canonical spelling of numbers and records, and fields read out of text."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def spelled_number(x: float) -> str | None:
    """Integral values as integers (both zeros as 0), others by their shortest form; nothing for what is not finite."""
    if x is None or not math.isfinite(x):
        return None
    return str(int(x)) if float(x).is_integer() else repr(float(x))


@F.pandas_udf(StringType())
def number_text(values: pd.Series) -> pd.Series:
    return values.map(spelled_number)


@F.pandas_udf(StringType())
def text_literal(values: pd.Series) -> pd.Series:
    """JSON string literals that leave text beyond ASCII as it is."""
    return values.map(lambda v: None if v is None else json.dumps(v, ensure_ascii=False))


def canonical(types: dict[str, str]) -> Column:
    """Compact JSON of the columns named, keys in code point order, numbers in canonical spelling, nulls kept.

    ``types`` gives each column's type: double, text, or other (spelled as Spark casts it: integers and booleans).
    """
    spell = {"double": number_text, "text": text_literal, "other": lambda c: F.col(c).cast("string")}
    parts = [F.concat(F.lit(f"{json.dumps(k)}:"), F.coalesce(spell[types[k]](k), F.lit("null"))) for k in sorted(types)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def field_map(text: Column, pattern: str) -> Column:
    """A map of the pattern's first group to its second, over all matches; the last match of a name wins."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))
    return F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def common_prefix(left: Column, right: Column) -> Column:
    """The number of leading elements that two arrays share; nulls equal nulls."""
    differs = F.array_position(F.zip_with(F.slice(left, 1, F.least(F.size(left), F.size(right))), F.slice(right, 1, F.least(F.size(left), F.size(right))), lambda a, b: a.eqNullSafe(b)), False)
    return F.when(left.isNotNull() & right.isNotNull(), F.when(differs == 0, F.least(F.size(left), F.size(right)).cast("bigint")).otherwise(differs - 1))


def relation_slots(n: Column) -> Column:
    """Predicate and distance slots of a scene of n objects: 9 n (n - 1) + n (n - 1) (n - 2) / 2 + 2 n."""
    return 9 * n * (n - 1) + (n * (n - 1) * (n - 2) / 2).cast("bigint") + 2 * n
