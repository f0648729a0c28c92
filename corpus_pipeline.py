"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of documents. Toxic documents go; of equal texts the largest id stays, of a near-duplicate component the
smallest; the mix repeats or drops documents to meet its sources' targets (a document at the end of a
source's quota is cut); the last stage gives the tokens of each row of the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodequery.llm import bpe, exact_dedup, mixing, simhash, toxicity
from lodequery.llm.common import delete, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, outputs=("ids",)).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("mixing", mix_sources), ("bpe", tokenize)]

#: The classifier and the tokenizer have no SQL form; the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written as Parquet to the shared folder and read again.

    A stage's table goes when its successor's is written, the last one when the application ends.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    delete(spark, folder, at_exit=True)
    return docs
