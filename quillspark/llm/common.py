"""Shared storage and connected components for the operators of this package."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset (local tests) a
    temporary folder of this process is used.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


#: Rows of a batch of texts that Python gets at once, at most.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Have the session ship texts to Python in small batches, so that workers hold few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on batches that gives its worker's freed memory back at its end: workers live on between stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what is written in here as soon as it is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def durable(df: DataFrame, name: str, partition_by: str | None = None, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (or another one) and read it back; this cuts its lineage."""
    spark = df.sparkSession
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with _shuffles_freed(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def release(written: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete the files behind a frame of :func:`durable`, or at a path, that nothing reads any more."""
    path = written if isinstance(written, str) else getattr(written, "_quill_path", None)
    if path:
        spark = spark or written.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit the pattern, in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return [f.getPath().toString() for f in found or []]


def drop_table(df: DataFrame) -> None:
    """Drop the table behind a frame of :func:`durable_bucketed`, and its files."""
    spark, table = df.sparkSession, getattr(df, "_quill_table", None)
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        release(df)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of an undirected edge list with the smallest node it reaches.

    Alternating large-star and small-star steps on DataFrames (minimum per node, then an equi
    join), each written to the shared folder; nothing is gathered per node, so hubs are only
    join keys, which adaptive execution splits. Null ends and self loops are dropped. Returns
    (node, component) for nodes that have at least one edge to another node.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = durable(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every pair points down already, so the neighbours are the v of each u.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = durable(kept.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(pairs)
        pairs = after
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    tops = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(tops.select("node", F.col("node").alias("component")))


def durable_bucketed(df: DataFrame, name: str, key: str, partition_by: str | None = None) -> DataFrame:
    """Like :func:`durable`, in buckets of ``key``, so that later joins and groups by it do not move these rows."""
    spark = df.sparkSession
    table = f"quill_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with _shuffles_freed(spark):
        writer.bucketBy(n, key).saveAsTable(table)
    out = spark.table(table)
    out._quill_path, out._quill_table = path, table
    return out
