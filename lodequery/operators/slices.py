"""Contiguous slices of a sequence whose heaviest load is least: bisection on the load, with a packing pass for each guess.

Edge cases: a null cost is zero; negative costs are an error. A key whose first load alone is heaviest has an empty first slice. Items that tie in
the order are taken as sorted by cost. Empty input gives no rows. A key's costs are held by one task, 8 bytes for each item.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binding import read

#: Fixed value: steps of the bisection.
STEPS = 60


def pack(sums: list[float], first: float, budget: float, most: int) -> tuple[list[int] | None, float, float]:
    """Slices that each take all they can under a budget: their ends (None if more than ``most`` are needed), the heaviest load, and the least budget that would pack otherwise.

    ``sums`` are the running sums of the costs, from 0. Each slice is found by a search, so a pass takes as many steps as there are slices.
    """
    ends, at, load, heaviest, other, last = [], 0, first, first, math.inf, len(sums) - 1
    while True:
        to = max(bisect_right(sums, sums[at] + budget - load) - 1, at)
        ends.append(to)
        heaviest = max(heaviest, sums[to] - sums[at] + load)
        if to == last:
            return ends, heaviest, other
        other = min(other, sums[to + 1] - sums[at] + load)
        if len(ends) == most:
            return None, heaviest, other
        at, load = to, 0.0


def least_heaviest(costs: list[float], most: int, first: float = 0.0) -> list[int]:
    """The ends of at most ``most`` slices whose heaviest load is least; ``first`` is a load the first slice has besides.

    The bisection's lower end moves to the least budget that packs otherwise and its upper end to the load of the packing found, so it ends when they meet.
    """
    if any(c < 0 for c in costs):
        raise ValueError("costs must not be negative")
    sums = [0.0, *accumulate(costs)]
    low, high = max([first, *costs]), sums[-1] + first
    best = [len(costs)]
    for step in range(STEPS):
        guess = low if step == 0 else (low + high) / 2
        found, heaviest, other = pack(sums, first, guess, most)
        if found:
            best, high = found, min(heaviest, guess)
        else:
            low = max(other, guess)
        if low >= high or step == 0 and found:
            return best
    return pack(sums, first, low, most)[0] or best


def lightest_slices(items: DataFrame, keys: list[str], order: list[str], cost: str, most: int, first: float = 0.0) -> DataFrame:
    """(keys, slice, n, load, heaviest): each key's items in order, in at most ``most`` slices of which the heaviest is as light as can be."""
    kinds = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in keys)
    item = F.struct(*order, F.coalesce(F.col(cost).cast("double"), F.lit(0.0)).alias("_cost"))
    costs = items.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["_cost"]).alias("_costs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, held in batch.itertuples(index=False, name=None):
                ends = least_heaviest(held.tolist(), most, first)
                sums = [0.0, *accumulate(held.tolist())]
                loads = [sums[j] - sums[i] + (first if k == 0 else 0.0) for k, (i, j) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]
                rows += [(*key, k, j - i, load, max(loads)) for k, (i, j, load) in enumerate(zip([0, *ends[:-1]], ends, loads, strict=True))]
            yield pd.DataFrame(rows, columns=[*keys, "slice", "n", "load", "heaviest"])

    return costs.mapInPandas(cut, f"{kinds}, slice int, n bigint, load double, heaviest double")


def q_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lightest_slices(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber"], "l_quantity", 3, 20.0)
    return found.groupBy("l_orderkey").agg(F.sum("n").alias("n"), F.round(F.max("heaviest"), 6).alias("heaviest"))


QUERIES = {"lightest_slices": q_slices}
SQL = {
    "lightest_slices": """
        WITH sums AS (
            SELECT l_orderkey, row_number() OVER w AS i, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity)
        ), ends AS (
            SELECT l_orderkey, i, s FROM sums UNION ALL SELECT DISTINCT l_orderkey, 0, 0 FROM lineitem
        ), whole AS (
            SELECT l_orderkey, max(i) AS n, max(s) AS total FROM ends GROUP BY 1
        )
        SELECT l_orderkey, n, round(min(greatest(20 + a.s, b.s - a.s, total - b.s)), 6) AS heaviest
        FROM whole JOIN ends a USING (l_orderkey) JOIN ends b USING (l_orderkey) WHERE a.i <= b.i GROUP BY ALL
    """
}
