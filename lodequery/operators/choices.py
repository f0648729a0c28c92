"""Scores of offered choices: softmax shares, the choice with its margin, and the distance between two paths' shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..binding import read


def shares(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Adds share: the softmax over the offered choices of each request; choices without a score are not offered."""
    w = Window.partitionBy(*keys)
    lifted = scores.filter(F.col(score).isNotNull()).withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return lifted.withColumn("share", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def chosen(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The best choice of each request (ask on an exact tie of the best), its margin to the next, and the log of the sum."""
    w = Window.partitionBy(*keys)
    ranked = scores.filter(F.col("score").isNotNull()).withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "choice"))).withColumn("top", F.max("score").over(w))
    summed = ranked.groupBy(*keys).agg(
        F.max("top").alias("top"),
        F.max(F.when(F.col("place") == 1, F.col("choice"))).alias("first"),
        F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"),
        F.sum(F.exp(F.col("score") - F.col("top"))).alias("total"),
    )
    pick = F.when(F.col("second") == F.col("top"), "ask").otherwise(F.col("first"))
    return summed.select(*keys, pick.alias("choice"), F.round(F.col("top") - F.col("second"), 6).alias("margin"), F.round(F.col("top") + F.log("total"), 6).alias("log_sum"))


def path_distance(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Half the summed difference of two paths' shares for each request; a choice that one path lacks counts as zero there."""
    both = first.select(*keys, "choice", F.col("share").alias("p")).join(second.select(*keys, "choice", F.col("share").alias("q")), [*keys, "choice"], "full_outer").fillna(0.0, ["p", "q"])
    return both.groupBy(*keys).agg(F.round(0.5 * F.sum(F.abs(F.col("p") - F.col("q"))), 6).alias("distance"), F.count_if(F.greatest("p", "q") >= 0.01).alias("plausible"))


def offered(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Six choices of each request, with the embedding's elements as scores; one in 13 requests has a tie of the best."""
    e = lambda i: F.element_at("embedding", i + shift).cast("double") * 10
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(*[F.struct(F.lit(c).alias("choice"), F.when((F.col("vec_id") % 13 == 0) & F.lit(c in "AB"), 99.0).otherwise(e(i + 1)).alias("score")) for i, c in enumerate("ABCDEF")])).alias("s"))
    return rows.select("vec_id", "s.*")


def q_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(offered(spark, sf_dir), ["vec_id"]).select("vec_id", "choice", F.round("share", 6).alias("share"))


def q_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(offered(spark, sf_dir), ["vec_id"])


def q_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_distance(shares(offered(spark, sf_dir), ["vec_id"]), shares(offered(spark, sf_dir, 6), ["vec_id"]), ["vec_id"])


def _offered(name: str, shift: int) -> str:
    parts = " UNION ALL ".join(f"SELECT vec_id, '{c}' AS choice, {'CASE WHEN vec_id % 13 = 0 THEN 99.0::DOUBLE ELSE' if c in 'AB' else '('} embedding[{i + 1 + shift}]::DOUBLE * 10 {'END' if c in 'AB' else ')'} AS score FROM embeddings" for i, c in enumerate("ABCDEF"))
    return f"{name}_o AS ({parts}), {name}_e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY vec_id)) AS e FROM {name}_o), {name} AS (SELECT vec_id, choice, score, e / sum(e) OVER (PARTITION BY vec_id) AS share FROM {name}_e)"


QUERIES = {"choice_shares": q_shares, "choice_margin": q_chosen, "path_distance": q_distance}
SQL = {
    "choice_shares": f"WITH {_offered('a', 0)} SELECT vec_id, choice, round(share, 6) AS share FROM a",
    "choice_margin": f"""
        WITH {_offered('a', 0)}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, choice) AS n FROM a),
        t AS (SELECT vec_id, max(score) AS top, max(CASE WHEN n = 1 THEN choice END) AS best, max(CASE WHEN n = 2 THEN score END) AS nxt FROM r GROUP BY 1)
        SELECT t.vec_id, CASE WHEN nxt = top THEN 'ask' ELSE best END AS choice, round(top - nxt, 6) AS margin, round(top + ln(s), 6) AS log_sum FROM t JOIN (SELECT r.vec_id, sum(exp(score - top)) AS s FROM r JOIN t USING (vec_id) GROUP BY 1) z ON z.vec_id = t.vec_id
    """,
    "path_distance": f"WITH {_offered('a', 0)}, {_offered('b', 6)} SELECT vec_id, round(0.5 * sum(abs(a.share - b.share)), 6) AS distance, count(*) FILTER (greatest(a.share, b.share) >= 0.01) AS plausible FROM a JOIN b USING (vec_id, choice) GROUP BY 1",
}
