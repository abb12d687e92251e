"""The bounded sample of labelled rows that the classifiers of this package are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def held_out(doc_id: Column) -> Column:
    """True for rows that no classifier may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled rows of either class.

    Ids are taken in the order of a hash of doc_id, one row each, so the sample doesn't depend on the
    files' order. Ids with contradicting labels are left out, labels other than 0 and 1 too.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    picked = [r for value in (0, 1) for r in rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType())])
    chosen = docs.sparkSession.createDataFrame(picked, schema)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # One row an id, so that repeated ids don't lift the bound: that of the least hash of its text.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")
