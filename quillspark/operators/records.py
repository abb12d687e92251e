"""Projections of layered records: the last value by priority, stars of duplicates, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import vocabulary


def truthy(name: str, kind: str) -> Column:
    """The column, or null where it is empty: 0, '' and [] count as absent."""
    c = F.col(name)
    if kind.startswith("array"):
        return F.when(F.size(c) > 0, c)
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.nullif(c, F.lit(0).cast(kind))
    return F.nullif(c, F.lit("")) if kind == "string" else c


def last_values(rows: DataFrame, key: str, priority: list[str], fields: list[str]) -> DataFrame:
    """For every key and field the last present value in ascending priority (nulls lowest).

    One aggregation: ``max_by`` over the priority of rows that have the field; priorities must be
    unique within a key to be deterministic.
    """
    kinds = dict(rows.dtypes)
    rank = F.struct(*[F.struct(F.col(p).isNotNull().alias("known"), F.col(p).alias("p")).alias(f"p{i}") for i, p in enumerate(priority)])
    return rows.groupBy(key).agg(*[F.max_by(F.col(f), F.when(truthy(f, kinds[f]).isNotNull(), rank)).alias(f) for f in fields])


def last_wins(rows: DataFrame, key: str, priority: list[str], field: str) -> DataFrame:
    """The value of the last row outright, absent or not."""
    rank = F.struct(*[F.struct(F.col(p).isNotNull().alias("known"), F.col(p).alias("p")).alias(f"p{i}") for i, p in enumerate(priority)])
    return rows.groupBy(key).agg(F.max_by(field, rank).alias(field))


def annotations_by_scheme(rows: DataFrame, key: str, priority: list[str]) -> DataFrame:
    """Rows (key, scheme, label, value, ...) of the last layer that mentions the scheme, per key and scheme."""
    rank = F.struct(*[F.col(p) for p in priority])
    # The rank as a column: where the caller drops what it is made of, that doesn't travel beside it.
    ranked = rows.withColumn("rank_", rank).withColumn("best_", F.max("rank_").over(Window.partitionBy(key, "scheme")))
    return ranked.where(F.col("rank_").eqNullSafe(F.col("best_"))).drop("rank_", "best_")


def positive_labels(annotations: DataFrame, key: str) -> DataFrame:
    """key, annotations: sorted ``scheme/label`` of true boolean annotations."""
    true = annotations.where("annotation_type = 'boolean' and value")
    return true.groupBy(key).agg(F.array_sort(F.collect_set(F.concat_ws("/", "scheme", "label"))).alias("annotations"))


def inclusion_score(kind: Column, value: Column, score: Column, data_score: Column) -> Column:
    """The data's own score; of a boolean the score, or its complement where false; else the score."""
    return F.coalesce(data_score, F.when(kind == "boolean", F.when(value, score).otherwise(1 - score)).when(kind == "score", score))


def ordered_authors(authors: Column) -> Column:
    """Names of (display_name, position) structs: first, middle, last; ties alphabetically."""
    rank = lambda p: F.when(p == "first", 0).when(p == "middle", 1).otherwise(2)
    keyed = F.transform(authors, lambda a: F.struct(rank(a["position"]).alias("r"), a["display_name"].alias("n")))
    return F.transform(F.array_sort(keyed), lambda a: a["n"])


def canonical_of(ids: DataFrame, decisions: DataFrame, key: str = "reference_id") -> DataFrame:
    """Every id with the canonical its active decision names, or itself (one hop)."""
    active = decisions.where("active_decision and canonical_reference_id is not null").select(F.col("reference_id").alias(key), "canonical_reference_id")
    return ids.join(active, key, "left").withColumn("canonical_id", F.coalesce("canonical_reference_id", key)).drop("canonical_reference_id")


def star(children: DataFrame, decisions: DataFrame, key: str = "reference_id") -> DataFrame:
    """Children of canonicals and of their active duplicates under the canonical's id, own first.

    ``own`` tells a canonical's children from its duplicates'; the child's own reference stays.
    """
    return canonical_of(children, decisions, key).withColumn("own", F.col(key) == F.col("canonical_id"))


def canonical_like(determination: Column) -> Column:
    """All but duplicates, those without a decision included."""
    return F.coalesce(~determination.isin("duplicate"), F.lit(True))


def is_canonical(determination: Column) -> Column:
    return F.when(determination.isNotNull(), determination == "canonical")


def batch_status(statuses: Column) -> Column:
    """Import batch status of the distinct statuses of its results; null for an unforeseen mix."""
    has = lambda *names: F.arrays_overlap(statuses, F.array(*[F.lit(n) for n in names]))
    only = lambda *names: F.size(F.array_except(statuses, F.array(*[F.lit(n) for n in names]))) == 0
    return (
        F.when(statuses.isNull() | only("created"), "created")
        .when(has("started", "retrying", "created"), "started")
        .when(only("completed"), "completed")
        .when(only("failed", "partially_failed"), "failed")
        .when(has("completed") & has("failed", "partially_failed"), "partially_failed")
    )


def request_status(statuses: Column, before: Column) -> Column:
    """Enhancement request status of its pending rows' statuses; expired ones have no weight."""
    live = F.array_remove(F.coalesce(statuses, F.array().cast("array<string>")), "expired")
    has = lambda *names: F.arrays_overlap(live, F.array(*[F.lit(n) for n in names]))
    only = lambda name: F.size(F.array_remove(live, name)) == 0
    return (
        F.when(F.size(live) == 0, before)
        .when(only("pending"), "received")
        .when(has("pending", "processing", "importing", "indexing"), "processing")
        .when(only("completed"), "completed")
        .when(only("failed"), "failed")
        .otherwise("partial_failed")
    )


def with_children(parents: DataFrame, children: DataFrame, key: str, name: str, fields: list[str], order: list[str]) -> DataFrame:
    """Parents with an ordered array of child structs, empty where they have none."""
    packed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))
    joined = parents.join(packed, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))


#: Statuses of import results, in the order of a batch's summary.
RESULT_STATUSES = ("created", "started", "completed", "partially_failed", "failed", "retrying", "cancelled")


def batch_summary(results: DataFrame, key: str) -> DataFrame:
    """For every batch the number of results of each status, zeros included, and the failures' details.

    ``results``: key, status, failure_details.
    """
    counts = [F.count_if(F.col("status") == s).alias(s) for s in RESULT_STATUSES]
    failures = F.array_sort(F.collect_list(F.when(F.col("status").isin("failed", "partially_failed"), F.col("failure_details"))))
    return results.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *counts, failures.alias("failure_details"))


def best_scores(scored: DataFrame, key: str, winner: str) -> DataFrame:
    """best and best_other: the greatest probability of a key's candidates, and of those but the winner."""
    other = F.when(~F.col("candidate_id").eqNullSafe(F.col(winner)), F.col("probability"))
    return scored.groupBy(key).agg(F.max("probability").alias("best"), F.max(other).alias("best_other"))


def first_identifier(identifiers: Column, kind: str) -> Column:
    return F.get(F.filter(identifiers, lambda x: x["identifier_type"] == kind), F.lit(0))["identifier"]


def bool_annotation(annotations: Column, scheme: str, label: str) -> Column:
    """True or false as the last boolean annotation of the scheme and label says; null without one."""
    own = F.filter(annotations, lambda a: (a["scheme"] == scheme) & (a["label"] == label) & (a["annotation_type"] == "boolean"))
    return F.get(F.reverse(own), F.lit(0))["value"]


def searchable_layers(enhancements: Column) -> Column:
    """Layers that search documents hold: no raw records, associations or linked data."""
    return F.filter(enhancements, lambda e: ~e["enhancement_type"].isin("raw", "reference_association", "linked_data"))


def search_documents(layers: DataFrame, annotations: DataFrame, decisions: DataFrame, fields: list[str]) -> DataFrame:
    """Search documents of canonical-like references: the canonical's layers and its duplicates' in one.

    ``layers``: reference_id, enhancement_type, created_at, tie, abstract and ``fields``; a field is
    the last present one of bibliographic layers, the abstract that of the last abstract layer
    outright. ``annotations``: reference_id, created_at, tie, scheme, label, annotation_type, value;
    a scheme counts as its last layer has it. A canonical's own layers come after its duplicates'.
    """
    priority = ["own", "created_at", "tie"]
    whole = star(layers, decisions).drop("reference_id")
    fresh = last_values(whole.where("enhancement_type = 'bibliographic'"), "canonical_id", priority, fields)
    abstracts = last_wins(whole.where("enhancement_type = 'abstract'"), "canonical_id", priority, "abstract")
    notes = star(annotations, decisions).drop("reference_id")
    noted = annotations_by_scheme(notes, "canonical_id", priority)
    # Every scheme has a last layer, so which ones there are needs no ranks.
    evaluated = notes.groupBy("canonical_id").agg(F.array_sort(F.collect_set("scheme")).alias("evaluated_schemes"))
    ids = canonical_of(layers.select("reference_id").unionByName(annotations.select("reference_id")).distinct(), decisions).select("canonical_id").distinct()
    out = ids
    for part in (fresh, abstracts, positive_labels(noted, "canonical_id"), evaluated):
        out = out.join(part, "canonical_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("annotations", "evaluated_schemes")}).withColumnRenamed("canonical_id", "id")


def projected_scores(annotations: DataFrame, decisions: DataFrame, scores: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(id, and a score by name) of canonical-like references: that of the last annotation of a scheme, or of a scheme and label.

    ``annotations``: reference_id, created_at, tie, position, scheme, label, annotation_type, value, score, data_score. The
    last one counts outright (see :func:`inclusion_score`), a canonical's own after its duplicates'.
    """
    rows = star(annotations, decisions).withColumn("score_", inclusion_score(F.col("annotation_type"), F.col("value"), F.col("score"), F.col("data_score")))
    rank = F.struct("own", "created_at", "tie", "position")
    of = lambda scheme, label: (F.col("scheme") == scheme) & (F.lit(True) if label is None else F.col("label") == label)
    last = [F.max_by("score_", F.when(of(*key), rank)).alias(name) for name, key in scores.items()]
    return rows.groupBy(F.col("canonical_id").alias("id")).agg(*last)


def linked_fields(layers: DataFrame, decisions: DataFrame, triples: DataFrame, country_properties: list[str], regions: DataFrame) -> DataFrame:
    """(id, concepts, labels, evaluated, countries, regions) of canonical-like references with linked data.

    ``layers``: reference_id, created_at, tie, data (linked-data JSON), of which the last one of a star counts outright;
    ``triples`` is the vocabulary, ``regions`` a table (country, region).
    """
    last = last_wins(star(layers, decisions).drop("reference_id"), "canonical_id", ["own", "created_at", "tie"], "data")
    values = vocabulary.coded_rows(last.select(F.col("canonical_id").alias("reference_id"), "data"))
    found = vocabulary.project_discovered(values, triples)
    there = vocabulary.countries(values, country_properties)
    out = last.select(F.col("canonical_id").alias("reference_id"))
    for part in (found, there, vocabulary.regions_of(there, regions)):
        out = out.join(part, "reference_id", "left")
    none = F.array().cast("array<string>")
    fields = ("concepts", "labels", "evaluated", "countries", "regions")
    return out.select(F.col("reference_id").alias("id"), *(F.coalesce(c, none).alias(c) for c in fields))


def resync(documents: DataFrame, changed: DataFrame, decisions: DataFrame, fresh: DataFrame) -> DataFrame:
    """``documents`` after some references changed: those of their canonicals are replaced by
    ``fresh`` ones, and those of references that now are duplicates go."""
    canonical = canonical_of(changed.select("reference_id").distinct(), decisions)
    stale = canonical.select(F.col("canonical_id").alias("id")).unionByName(canonical.select(F.col("reference_id").alias("id"))).distinct()
    renewed = fresh.join(canonical.select(F.col("canonical_id").alias("id")).distinct(), "id", "left_semi")
    return documents.join(stale, "id", "left_anti").unionByName(renewed)


def canonical_with_changes(changes: DataFrame, references: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every changed reference's canonical record next to what changed, joined by id."""
    placed = canonical_of(changes, decisions).withColumnRenamed("reference_id", "changed_id")
    return placed.join(references.withColumnRenamed("reference_id", "canonical_id"), "canonical_id")


def hydrated(ids: DataFrame, enhancements: DataFrame, identifiers: DataFrame, enhancement_types: tuple[str, ...] = (), identifier_types: tuple[str, ...] = ()) -> DataFrame:
    """References with arrays of their layers and identifiers, of the given types only; none given, all."""
    wanted = lambda df, c, kinds: df.where(F.col(c).isin(*kinds)) if kinds else df
    out = with_children(ids.select("reference_id").distinct(), wanted(enhancements, "enhancement_type", enhancement_types), "reference_id", "enhancements", [c for c in enhancements.columns if c != "reference_id"], [])
    return with_children(out, wanted(identifiers, "identifier_type", identifier_types), "reference_id", "identifiers", [c for c in identifiers.columns if c != "reference_id"], [])


def looked_up(by_identifier: DataFrame, by_id: DataFrame, decisions: DataFrame) -> DataFrame:
    """Canonicals, once each, of references found by identifier or by id."""
    return canonical_of(by_identifier.select("reference_id").unionByName(by_id.select("reference_id")).distinct(), decisions).select("canonical_id").distinct()


def available_fields(fields: Column) -> Column:
    """Of a map from field to availability those fields that don't count as compared."""
    return F.map_filter(fields, lambda _, v: v != "compared")


def accepted_layers(new: DataFrame, existing: DataFrame, references: DataFrame, decisions: DataFrame) -> DataFrame:
    """``new`` layers (reference_id, content_key, derived_from array of (reference_id) owners) with their outcome.

    failed: the reference isn't there, or a layer it derives from belongs to another star of
    duplicates; discarded: its reference has a layer of the same content, or an earlier new one
    has (by ``place``); else accepted.
    """
    there = references.select("reference_id").distinct().withColumn("there", F.lit(True))
    had = existing.select("reference_id", "content_key").distinct().withColumn("had", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("reference_id", "content_key").orderBy("place"))
    trees = canonical_of(references.select("reference_id"), decisions)
    own = trees.select("reference_id", F.col("canonical_id").alias("tree"))
    origins = new.select("place", "reference_id", F.explode("derived_from").alias("origin")).join(own, "reference_id", "left")
    foreign = origins.join(trees.select(F.col("reference_id").alias("origin"), F.col("canonical_id").alias("other")), "origin", "left").where(~F.col("tree").eqNullSafe(F.col("other")))
    marked = new.withColumn("nth", nth).join(there, "reference_id", "left").join(had, ["reference_id", "content_key"], "left").join(foreign.select("place").distinct().withColumn("foreign", F.lit(True)), "place", "left")
    outcome = F.when(F.col("there").isNull() | F.col("foreign"), "failed").when(F.col("had") | (F.col("nth") > 1), "discarded").otherwise("accepted")
    return marked.select(*new.columns, outcome.alias("outcome"))
