"""Salted hash keys, hash-stable shares and content ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def salted(salt: str, *parts: Column, separator: str = "\n") -> Column:
    return F.sha2(F.concat_ws(separator, F.lit(salt), *[p.cast("string") for p in parts]), 256)


def share(digest: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def named_share(value: Column, weights: dict[str, float]) -> Column:
    """The name whose cumulative weight first exceeds the value."""
    out, upto = None, 0.0
    for name, weight in weights.items():
        upto += weight
        out = F.when(value < upto, name) if out is None else out.when(value < upto, name)
    return out.otherwise(list(weights)[-1])


def padded_id(prefix: str, number: Column, width: int = 3) -> Column:
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))
