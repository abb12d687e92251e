"""A corpus pipeline of five operators of ``quillspark.llm``, each a stage over all documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes what it returns as
Parquet in the shared folder and gives it, read again, to the next. All stages but the last return
the columns of ``documents``, with ``n_chars`` following the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, line_dedup, queries, simhash, toxicity
from quillspark.llm.common import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.3


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under ``TOXIC_FROM``."""
    docs = _documents(docs)
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("toxic_score") < TOXIC_FROM).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are similar to one before them."""
    done = line_dedup.without_repeated_lines(_documents(docs))
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of every group of near duplicates."""
    return simhash.one_of_each(_documents(docs)).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(_documents(docs), queries.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoded text."""
    return queries.bpe_digests(_documents(docs), queries.word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: A trained classifier and XXH64 fingerprints have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
