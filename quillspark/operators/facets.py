"""Facet counts: terms, sibling-aware terms, and two-dimensional cross-tabulations.

A document counts once for each distinct value of a multi-valued field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.search import Query, holds_any, sure

#: Buckets of a facet and cells of a cross-tabulation at most.
MAX_BUCKETS, MAX_CELLS = 1_000, 50_000


def values_of(column: str) -> Column:
    return F.explode(F.array_distinct(F.col(column)))


def terms(docs: DataFrame, query: Query, columns: list[str], max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """field, value, n of the most frequent values of each field (ties by value), in one pass."""
    from pyspark.sql import Window

    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.array_distinct(F.col(c)).alias("vs")) for c in columns])
    rows = docs.where(query.predicate()).select(F.explode(pairs).alias("p")).select("p.field", F.explode("p.vs").alias("value")).where("value is not null")
    counts = rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place_", place).where(F.col("place_") <= max_buckets).drop("place_")


def sibling_terms(docs: DataFrame, base: Query, column: str, groups: list[tuple[list[str], list[str] | None]], max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """group, value, n where every group's values are counted under the other groups' selections.

    ``base`` carries all filters but this facet's own. A group is (selected, siblings), siblings
    None for all values of the field. Values of a group that occur somewhere in the corpus but
    not under the selections count 0. Where all groups are enumerated, other values follow as
    group -1, counted under all selections.
    """
    members = [v for _, s in groups for v in s or []]
    if len(members) != len(set(members)):
        raise ValueError("groups of siblings overlap")
    if any(s is not None and len(s) > max_buckets for _, s in groups):
        raise ValueError(f"a group has more than {max_buckets} values")
    chosen = [holds_any(column, selected) if selected else F.lit(True) for selected, _ in groups]

    def among(i: int) -> Column:
        out = F.lit(True)
        for j, c in enumerate(chosen):
            out = out & c if j != i else out
        return out

    # One pass: each document names the groups under whose selections it counts.
    counted = F.array(*[F.when(among(i), F.lit(i)) for i in range(len(groups))], *([F.when(among(-1), F.lit(-1))] if all(s is not None for _, s in groups) else []))
    group_of = F.lit(None).cast("int")
    for i, (_, siblings) in enumerate(groups):
        fits = F.lit(True) if siblings is None else F.col("value").isin(siblings)
        group_of = F.when(F.col("g") == i, fits).otherwise(group_of.cast("boolean"))
    group_of = F.when(F.col("g") == -1, ~F.col("value").isin(members)).otherwise(group_of) if members or groups else group_of
    rows = docs.select(values_of(column).alias("value"), counted.alias("gs"), base.predicate().alias("hit"))
    # Domain values count 0; hits count 1.
    exploded = rows.select("value", "hit", F.explode(F.sequence(F.lit(-1), F.lit(len(groups) - 1))).alias("g"), "gs")
    counts = exploded.where(sure(group_of)).groupBy("g", "value").agg(F.count_if(F.col("hit") & F.array_contains(F.array_compact("gs"), F.col("g"))).alias("n"))
    enumerated = all(s is not None for _, s in groups)
    keep = (F.col("g") >= 0) if not enumerated else (F.col("g") >= 0) | (F.col("n") > 0)
    return counts.where(keep).select(F.col("g").alias("group"), "value", "n")


def cross(docs: DataFrame, query: Query, row: str, column: str, row_values: list[str] | None = None, column_values: list[str] | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """v0, v1, n of the non-empty cells, with search_total and mapped_total on each row.

    ``row_values`` and ``column_values`` limit an axis to a scheme's members; a document is mapped
    if it has a value on both axes. More cells than ``MAX_CELLS`` by ``sizes`` raise ValueError.
    """
    s0, s1 = sizes or (len(row_values or ()), len(column_values or ()))
    if s0 + s0 * s1 > MAX_CELLS:
        raise ValueError(f"{s0} x {s1} cells are more than {MAX_CELLS}")

    def axis(name: str, only: list[str] | None) -> Column:
        values = F.array_distinct(F.coalesce(F.col(name), F.array().cast("array<string>")))
        return values if only is None else F.array_intersect(values, F.array(*[F.lit(v) for v in only]).cast("array<string>"))

    hits = docs.where(query.predicate()).select(axis(row, row_values).alias("a"), axis(column, column_values).alias("b"))
    totals = hits.agg(F.count(F.lit(1)).alias("search_total"), F.count_if((F.size("a") > 0) & (F.size("b") > 0)).alias("mapped_total"))
    cells = hits.select(F.explode("a").alias("v0"), "b").select("v0", F.explode("b").alias("v1")).groupBy("v0", "v1").agg(F.count(F.lit(1)).alias("n"))
    return cells.crossJoin(F.broadcast(totals))
