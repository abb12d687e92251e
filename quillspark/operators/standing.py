"""Standing queries: registered predicates that every change is matched against.

A standing query is a Column over a frame of (reference struct, changeset struct, ...), written
with DataFrame functions; clauses that must hold for one and the same array element go into one
``exists``. All predicates are evaluated in one pass over the changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.search import sure

#: References in a batch at most.
BATCH = 10_000


def all_of(*clauses: Column) -> Column:
    out = F.lit(True)
    for c in clauses:
        out = out & sure(c)
    return out


def any_of(*clauses: Column) -> Column:
    out = F.lit(False)
    for c in clauses:
        out = out | sure(c)
    return out


def none_of(*clauses: Column) -> Column:
    return ~any_of(*clauses)


def element(array: Column, predicate) -> Column:
    """Some element of the array fits the predicate as a whole."""
    return sure(F.exists(array, lambda e: sure(predicate(e))))


def match(changes: DataFrame, queries: dict[str, Column], key: str) -> DataFrame:
    """(robot, key) of every standing query that a change fits; ``queries`` is by robot."""
    if not queries:
        return changes.select(F.lit("").alias("robot"), key).limit(0)
    fits = F.array_compact(F.array(*[F.when(sure(p), F.lit(name)) for name, p in sorted(queries.items())]))
    return changes.select(key, F.explode(fits).alias("robot")).select("robot", key).distinct()


def dispatch(matches: DataFrame, key: str, skip_robot: str | None = None, size: int = BATCH) -> DataFrame:
    """(robot, batch, references): batches of at most ``size`` sorted references for each robot,
    without the robot whose own result caused the change.

    References are dealt by hash, so no task sees all of a robot's; ``batch`` is unique by robot.
    """
    rows = (matches if skip_robot is None else matches.where(F.col("robot") != skip_robot)).where(F.col(key).isNotNull()).select("robot", F.col(key).alias("key_")).distinct()
    counts = rows.groupBy(F.col("robot").alias("robot_")).agg(F.ceil(F.count(F.lit(1)) / size).alias("buckets_"))
    dealt = rows.join(F.broadcast(counts), F.col("robot").eqNullSafe(F.col("robot_"))).withColumn("bucket_", F.pmod(F.xxhash64("key_"), "buckets_"))
    at = F.row_number().over(Window.partitionBy("robot", "bucket_").orderBy("key_")) - 1
    batch = F.col("bucket_") + F.col("buckets_") * F.floor(F.col("at_") / size)
    return dealt.withColumn("at_", at).groupBy("robot", batch.alias("batch")).agg(F.array_sort(F.collect_list("key_")).alias("references"))
