"""From raw documents to token ids: quality, exact copies, near copies, benchmark passages, encoding.

Each stage takes all rows that the one before kept, written as Parquet and read again, and returns the columns of
documents; the last adds token_ids and n_tokens.

Defined results: null texts count as empty (scored as texts without terms, equal to each other, linked with nothing, holding
no item, encoded as no ids) and stay null where they stay; texts of any length are taken whole; null ids lose against others
among exact copies and come first among near ones; of rows that repeat id and text one stays; of near copies with
the same id the one whose text has the lowest hash stays; an empty table gives none; further columns stay as they are,
whatever their names, but for token_ids and n_tokens, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.functions.store import saved
from scenewright.llm import bpe, decontaminate, exact_dedup, ngram_join, quality
from scenewright.llm._text import unused

#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.3


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose nearest labelled neighbours vote against them."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.predict(docs, model, keep=True)
    return scored.filter(F.col(scored.columns[-1]) >= LEAST_QUALITY).drop(scored.columns[-1])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; rows that repeat an id count by their text."""
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    groups = ngram_join.join(docs.select(key.alias("key"), "text"), doc_id="key")
    (name,) = unused(docs.columns, "key")
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, key).join(stay, name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with token_ids and n_tokens."""
    return bpe.encode(docs).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality classifier", by_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding", encoded),
]

#: SQL can't express the classifier, the similarity components or the encoding; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
