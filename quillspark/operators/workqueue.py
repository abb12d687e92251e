"""Work queue of pending enhancements as transformations: claims, leases, expiry, retries, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.relational import bulk_update, first_of_each, insert_ignore
from quillspark.operators.search import Query, scan

#: The states that a state may change to.
TRANSITIONS = {
    "pending": ["processing"],
    "processing": ["importing", "expired", "failed"],
    "importing": ["indexing", "discarded", "failed"],
    "indexing": ["completed", "indexing_failed"],
    "expired": [],
    "discarded": [],
    "failed": [],
    "completed": [],
    "indexing_failed": [],
}
MAX_RETRIES = 3
#: Fixed value: hits of a search request that are taken in at once.
PAGE_SIZE = 10_000


def allowed(before: Column, after: Column) -> Column:
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(table, before), after), F.lit(False))


def illegal(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Rows whose change of state isn't allowed; a whole update is refused if there is one."""
    return rows.where(~allowed(F.col(before), F.col(after)))


def claim(pending: DataFrame, robot, n: int) -> DataFrame:
    """The oldest pending rows of a robot, one a reference, ``n`` at most."""
    own = pending.where((F.col("robot_id") == F.lit(robot)) & (F.col("status") == "pending"))
    oldest = first_of_each(own, ["reference_id"], [F.col("created_at"), F.col("id")])
    return oldest.orderBy("created_at", "id").limit(n)


def request_pages(existing: DataFrame, docs: DataFrame, query: Query, request, robot, key: str, size: int = PAGE_SIZE, after=None) -> DataFrame:
    """New pending rows of a search request for hits beyond ``after``, with the page that each is of.

    Hits come in the order of their unique numeric key, ``size`` a page. A reference that the request asks for already,
    other than as a retry, is left out, so pages may be taken in again. Pages that are taken in in order leave a
    point to go on from: :func:`resume_key`.
    """
    found = scan(docs if after is None else docs.where(F.col(key) > F.lit(after)), query, key, size)
    new = found.select(F.lit(request).alias("request_id"), F.col(key).alias("reference_id"), F.lit(robot).alias("robot_id"), F.lit("pending").alias("status"), "page")
    return insert_ignore(existing.where("retry_of is null"), new, ["request_id", "reference_id"])


def resume_key(existing: DataFrame, request):
    """The last reference of a request that was taken in, or None."""
    return existing.where((F.col("request_id") == F.lit(request)) & F.col("retry_of").isNull()).agg(F.max("reference_id")).first()[0]


def lease(pending: DataFrame, claimed: DataFrame, now: Column, minutes: int) -> DataFrame:
    """The queue with the claimed rows in processing until the lease ends."""
    if minutes <= 0:
        raise ValueError("a lease must last")
    marked = pending.join(claimed.select("id").distinct().withColumn("claimed_", F.lit(True)), "id", "left")
    out = bulk_update(marked, F.col("claimed_"), status="processing", expires_at=now + F.expr(f"INTERVAL {minutes} MINUTES"))
    return out.drop("claimed_")


def expired(pending: DataFrame, now: Column, states: tuple[str, ...] = ("processing",)) -> DataFrame:
    """Rows in a leased state whose lease ended before now."""
    return pending.where(F.col("status").isin(*states) & (F.col("expires_at") < now))


def retries(gone: DataFrame, depths: DataFrame, most: int = MAX_RETRIES) -> DataFrame:
    """New pending rows for expired ones that may be tried again."""
    return gone.join(depths, "id").where(F.col("depth") < most).select("reference_id", "robot_id", F.col("id").alias("retry_of"), F.lit("pending").alias("status"))


def classify_results(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """line_no, reference_id and outcome of result lines, then a row for each reference not attempted.

    ``lines``: line_no (over non-blank lines), reference_id (null: it didn't parse), valid. In
    this order: parse failure, not in the request, repeated, invalid, add.
    """
    asked = expected.select("reference_id").distinct()
    known = lines.join(asked.withColumn("asked", F.lit(True)), "reference_id", "left")
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("reference_id").orderBy("line_no"))
    known = known.withColumn("nth", F.when(F.col("reference_id").isNotNull() & F.col("asked"), nth))
    outcome = (
        F.when(F.col("reference_id").isNull(), "parse_failure")
        .when(F.col("asked").isNull(), "not_requested")
        .when(F.col("nth") > 1, "repeated")
        .when(~F.coalesce("valid", F.lit(False)), "invalid")
        .otherwise("add")
    )
    done = known.select("line_no", "reference_id", outcome.alias("outcome"))
    lost = asked.join(lines.select("reference_id").where("reference_id is not null"), "reference_id", "left_anti")
    return done.unionByName(lost.select(F.lit(None).cast("long").alias("line_no"), "reference_id", F.lit("missing").alias("outcome")))
