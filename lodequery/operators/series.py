"""Ordered measurements: steady windows, load spans and jumps, quartiles and lag search, packing, lines, best rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import LOG, log, read
from ..functions.geometry import wrapped

DAY = 86_400_000_000
LAGS = 8


def steady(samples: DataFrame, keys: list[str], t: str, angle: str, seconds: int, degrees: float) -> DataFrame:
    """Adds spread and steady: the range of the angle, measured from the newest sample across the seam, since the last sample
    that is at least ``seconds`` (in the unit of t) old. Without so old a sample the row is not steady and spread is null."""
    order = Window.partitionBy(*keys).orderBy(t)
    recent = F.collect_list(angle).over(order.rangeBetween(-seconds + 1, 0))
    oldest = F.last(angle).over(order.rangeBetween(Window.unboundedPreceding, -seconds))
    turned = F.transform(F.col("_all"), lambda a: wrapped(a - F.col(angle)))
    spread = F.greatest(F.array_max(turned), F.lit(0.0)) - F.least(F.array_min(turned), F.lit(0.0))
    framed = samples.withColumn("_old", oldest).withColumn("_all", F.array_append(recent, F.col("_old")))
    return framed.withColumn("spread", F.when(F.col("_old").isNotNull(), spread)).withColumn("steady", F.coalesce(F.col("spread") <= degrees, F.lit(False))).drop("_old", "_all")


def load_spans(events: DataFrame, keys: list[str], load: str, unload: str) -> DataFrame:
    """(keys, from_us, to_us, closed): from a load to the next unload; a load before it replaces the earlier one, an open one ends with the log."""
    order = Window.partitionBy(*keys).orderBy("utc_us", "event_id")
    ends = events.withColumn("_last", F.max("utc_us").over(Window.partitionBy(*keys)))
    marks = ends.filter(F.col("ev").isin(load, unload)).select("*", F.lead("ev").over(order).alias("_next"), F.lead("utc_us").over(order).alias("_at"))
    spans = marks.filter((F.col("ev") == load) & (F.col("_next").isNull() | (F.col("_next") == unload)))
    return spans.select(*keys, F.col("utc_us").alias("from_us"), F.coalesce("_at", "_last").alias("to_us"), F.col("_next").isNotNull().alias("closed"))


def jumps(events: DataFrame, keys: list[str], load: str, unload: str, least: float) -> DataFrame:
    """(keys, event_id, step): changes of the value of at least ``least`` from the row before, but for those from a load up to its unload."""
    order = Window.partitionBy(*keys).orderBy("utc_us", "event_id")
    mark = F.when(F.col("ev").isin(load, unload), F.col("ev"))
    open_ = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    stepped = events.select(*keys, "event_id", "ev", (F.col("value") - F.lag("value").over(order)).alias("step"), open_.alias("_open"))
    excused = F.coalesce(F.col("_open") == load, F.lit(False)) | (F.col("ev") == load)
    return stepped.filter((F.abs("step") >= least) & ~excused).select(*keys, "event_id", F.round("step", 6).alias("step"))


def exclusive_quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, q1, q2, q3) by positions i (n + 1) / 4 between neighbouring ranks; null below two values."""
    w = Window.partitionBy(*keys)
    ranked = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.row_number().over(w.orderBy(value)).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))

    def place(i: int) -> Column:
        return F.greatest(F.lit(1), F.least(F.floor(i * (F.col("_n") + 1) / 4), F.col("_n") - 1))

    near = [F.max(F.when(F.col("_r") == place(i) + d, F.col("_v"))).alias(f"_{i}{d}") for i in (1, 2, 3) for d in (0, 1)]
    held = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *near)
    part = lambda i: (F.col(f"_{i}0") * (4 - (i * (F.col("_n") + 1) - 4 * place(i))) + F.col(f"_{i}1") * (i * (F.col("_n") + 1) - 4 * place(i))) / 4
    return held.select(*keys, F.col("_n").alias("n"), *[F.when(F.col("_n") > 1, part(i)).alias(f"q{i}") for i in (1, 2, 3)])


def best_lag(samples: DataFrame, keys: list[str], order: str, value: str, delayed: str) -> DataFrame:
    """(keys, lag, spread): the lag of 0 to LAGS rows at which the differences of value and the delayed column vary least (quartile range), the smaller on ties."""
    early = samples.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(LAGS))).alias("lag"), F.col(order).alias("_o"), F.col(delayed).cast("double").alias("_x")).withColumn("_o", F.col("_o") + F.col("lag"))
    gaps = samples.select(*keys, F.col(order).alias("_o"), F.col(value).alias("_y")).join(early, [*keys, "_o"]).withColumn("_d", F.col("_y") - F.col("_x"))
    spread = exclusive_quartiles(gaps, [*keys, "lag"], "_d").filter("n > 1").withColumn("spread", F.round(F.col("q3") - F.col("q1"), 6))
    return spread.groupBy(*keys).agg(F.min(F.struct("spread", "lag")).alias("s")).select(*keys, "s.lag", "s.spread")


def packed(items: DataFrame, keys: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """Adds slice: items in order fill a slice until the next would pass the budget; one dearer than the budget has its own; a null cost is zero.

    A key's items come sorted to one task, which keeps only the running slice and sum, so a key may be of any length.
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, number, total = None, 0, 0.0
        for b in batches:
            out = []
            for *key, price in b[[*keys, cost]].itertuples(index=False):
                price = 0 if pd.isna(price) else price
                if key != current:
                    current, number, total = key, 0, 0.0
                elif total + price > budget:
                    number, total = number + 1, 0.0
                total += price
                out.append(number)
            yield b.assign(slice=pd.Series(out, index=b.index, dtype="int64"))

    ready = items.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ready.mapInPandas(step, items.select("*", F.lit(0).cast("bigint").alias("slice")).schema)


def lines(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, a, b) of y = a + b x by least squares; b is zero for a single x. Pairs with a null are left out."""
    held = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_v"))
    slope = F.when(F.col("_v") > 0, F.col("_c") / F.nullif(F.col("_v"), F.lit(0.0))).otherwise(0.0)
    return sums.withColumn("b", slope).select(*keys, "n", (F.col("_my") - F.col("b") * F.col("_mx")).alias("a"), "b")


def requests(events: DataFrame, keys: list[str], send: str, token: str, end: str) -> DataFrame:
    """(keys, sent_us, first_us, ended_us, wait_us): one row for each request, its last sending, first token and last end."""
    at = lambda ev: F.when(F.col("ev") == ev, F.col("utc_us"))
    pivot = events.groupBy(*keys).agg(F.max(at(send)).alias("sent_us"), F.min(at(token)).alias("first_us"), F.max(at(end)).alias("ended_us"))
    return pivot.filter("sent_us is not null").withColumn("wait_us", F.when(F.col("first_us") >= F.col("sent_us"), F.col("first_us") - F.col("sent_us")))


def q_steady(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = log(spark, sf_dir).groupBy("session", "utc_us").agg(F.min("event_id").alias("event_id"), F.min((F.col("k") * 7 % 360 - 180).cast("double")).alias("yaw"))
    return steady(samples, ["session"], "utc_us", "yaw", DAY, 120.0).select("session", "event_id", F.round("spread", 6).alias("spread"), "steady")


def q_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_spans(log(spark, sf_dir), ["session"], "click", "purchase")


def q_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jumps(log(spark, sf_dir), ["session"], "click", "purchase", 40.0)


def q_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exclusive_quartiles(log(spark, sf_dir), ["session"], "value").select("session", "n", *[F.round(f"q{i}", 6).alias(f"q{i}") for i in (1, 2, 3)])


def q_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_lag(log(spark, sf_dir), ["session"], "seq", "value", "k")


def q_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(log(spark, sf_dir).select("session", "seq", "event_id", "k"), ["session"], ["seq"], "k", 200)


def q_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).withColumn("x", F.when(F.col("session") % 10 == 0, 5).otherwise(F.col("k")).cast("double"))
    return lines(rows, ["session"], "x", "value").select("session", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def q_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of the highest value of each session, the earlier one on ties."""
    return log(spark, sf_dir).groupBy("session").agg(F.max_by("event_id", F.struct("value", -F.col("seq"))).alias("event_id"), F.max("value").alias("value"))


def q_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(log(spark, sf_dir), ["session", "k"], "click", "view", "purchase")


QUERIES = {
    "steady_window": q_steady,
    "load_spans": q_spans,
    "value_jumps": q_jumps,
    "exclusive_quartiles": q_quartiles,
    "lag_search": q_lag,
    "budget_slices": q_packed,
    "fitted_lines": q_lines,
    "best_row": q_best,
    "request_pivot": q_requests,
}
_WRAP = "(CASE WHEN a - yaw > 180 THEN a - yaw - 360 WHEN a - yaw <= -180 THEN a - yaw + 360 ELSE a - yaw END)"
_PLACE = "greatest(1, least({i} * (n + 1) // 4, n - 1))"


def _quartile(i: int) -> str:
    p = _PLACE.format(i=i)
    return f"CASE WHEN max(n) > 1 THEN (max(CASE WHEN r = {p} THEN v * (4 - ({i} * (n + 1) - 4 * {p})) END) + max(CASE WHEN r = {p} + 1 THEN v * ({i} * (n + 1) - 4 * {p}) END)) / 4 END"


SQL = {
    "steady_window": f"""
        WITH {LOG}, s AS (SELECT session, utc_us, min(event_id) AS event_id, min((k * 7 % 360 - 180)::DOUBLE) AS yaw FROM log GROUP BY ALL),
        o AS (SELECT s.*, (SELECT max(p.utc_us) FROM s p WHERE p.session = s.session AND p.utc_us <= s.utc_us - {DAY}) AS since FROM s),
        w AS (SELECT o.session, o.event_id, o.yaw, o.since, p.yaw AS a FROM o LEFT JOIN s p ON p.session = o.session AND p.utc_us BETWEEN o.since AND o.utc_us),
        g AS (SELECT session, event_id, CASE WHEN since IS NOT NULL THEN round(greatest(max{_WRAP}, 0) - least(min{_WRAP}, 0), 6) END AS spread FROM w GROUP BY session, event_id, since)
        SELECT session, event_id, spread, coalesce(spread <= 120, false) AS steady FROM g
    """,
    "load_spans": f"""
        WITH {LOG}, e AS (SELECT *, max(utc_us) OVER (PARTITION BY session) AS ends FROM log),
        m AS (SELECT *, lead(ev) OVER w AS nxt, lead(utc_us) OVER w AS next_us FROM e WHERE ev IN ('click', 'purchase') WINDOW w AS (PARTITION BY session ORDER BY utc_us, event_id))
        SELECT session, utc_us AS from_us, coalesce(next_us, ends) AS to_us, nxt IS NOT NULL AS closed FROM m WHERE ev = 'click' AND coalesce(nxt, 'purchase') = 'purchase'
    """,
    "value_jumps": f"""
        WITH {LOG}, s AS (
            SELECT session, event_id, ev, value - lag(value) OVER w AS step, last_value(CASE WHEN ev IN ('click', 'purchase') THEN ev END IGNORE NULLS) OVER (PARTITION BY session ORDER BY utc_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
            FROM log WINDOW w AS (PARTITION BY session ORDER BY utc_us, event_id)
        )
        SELECT session, event_id, round(step, 6) AS step FROM s WHERE abs(step) >= 40 AND ev <> 'click' AND coalesce(mark, '') <> 'click'
    """,
    "exclusive_quartiles": f"""
        WITH {LOG}, q AS (SELECT session, value AS v, row_number() OVER (PARTITION BY session ORDER BY value) AS r, count(*) OVER (PARTITION BY session) AS n FROM log WHERE value IS NOT NULL)
        SELECT session, max(n) AS n, round({_quartile(1)}, 6) AS q1, round({_quartile(2)}, 6) AS q2, round({_quartile(3)}, 6) AS q3 FROM q GROUP BY session
    """,
    "lag_search": f"""
        WITH {LOG}, l AS (SELECT unnest(range(0, {LAGS + 1}))::INT AS lag), d AS (SELECT y.session, lag, y.value - x.k AS v FROM log y CROSS JOIN l JOIN log x ON x.session = y.session AND x.seq = y.seq - lag),
        q AS (SELECT *, row_number() OVER (PARTITION BY session, lag ORDER BY v) AS r, count(*) OVER (PARTITION BY session, lag) AS n FROM d WHERE v IS NOT NULL),
        s AS (SELECT session, lag, round({_quartile(3)} - {_quartile(1)}, 6) AS spread FROM q GROUP BY session, lag HAVING max(n) > 1), z AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY spread, lag) AS k FROM s)
        SELECT session, lag, spread FROM z WHERE k = 1
    """,
    "budget_slices": f"""
        WITH RECURSIVE {LOG}, p AS (
            SELECT session, seq, event_id, k, 0::BIGINT AS slice, k AS total FROM log WHERE seq = 0
            UNION ALL SELECT l.session, l.seq, l.event_id, l.k, p.slice + (p.total + l.k > 200)::BIGINT, CASE WHEN p.total + l.k > 200 THEN l.k ELSE p.total + l.k END FROM p JOIN log l ON l.session = p.session AND l.seq = p.seq + 1
        )
        SELECT session, seq, event_id, k, slice FROM p
    """,
    "fitted_lines": f"""
        WITH {LOG}, r AS (SELECT session, CASE WHEN session % 10 = 0 THEN 5 ELSE k END::DOUBLE AS x, value AS y FROM log), s AS (SELECT session, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)
        SELECT session, n, round(my - CASE WHEN v > 0 THEN c / v ELSE 0 END * mx, 6) AS a, round(CASE WHEN v > 0 THEN c / v ELSE 0 END, 6) AS b FROM s
    """,
    "best_row": f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY value DESC, seq) AS n FROM log) SELECT session, event_id, value FROM r WHERE n = 1",
    "request_pivot": f"""
        WITH {LOG}, p AS (SELECT session, k, max(utc_us) FILTER (ev = 'click') AS sent_us, min(utc_us) FILTER (ev = 'view') AS first_us, max(utc_us) FILTER (ev = 'purchase') AS ended_us FROM log GROUP BY ALL)
        SELECT *, CASE WHEN first_us >= sent_us THEN first_us - sent_us END AS wait_us FROM p WHERE sent_us IS NOT NULL
    """,
}
