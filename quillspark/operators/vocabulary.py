"""Controlled vocabularies and linked data as frames of triples (s, p, o)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import lineage
from quillspark.operators.lineage import cut

#: Predicates of the vocabularies.
IN_SCHEME = "http://www.w3.org/2004/02/skos/core#inScheme"
PREF_LABEL = "http://www.w3.org/2004/02/skos/core#prefLabel"
SUB_CLASS_OF = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RANGE = "http://www.w3.org/2000/01/rdf-schema#range"
CONCEPT = "http://www.w3.org/2004/02/skos/core#Concept"
CONCEPT_SCHEME = "http://www.w3.org/2004/02/skos/core#ConceptScheme"
OBJECT_PROPERTY = "http://www.w3.org/2002/07/owl#ObjectProperty"
ON_PROPERTY = "http://www.w3.org/2002/07/owl#onProperty"
ALL_VALUES_FROM = "http://www.w3.org/2002/07/owl#allValuesFrom"
EVIDENCE = "https://vocab.evidence-repository.org/"
CODING_ANNOTATION, CODED_VALUE = EVIDENCE + "CodingAnnotation", EVIDENCE + "codedValue"


def labels(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("p") == PREF_LABEL).groupBy(F.col("s").alias("concept")).agg(F.min("o").alias("label"))


def schemes(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("p") == IN_SCHEME).select(F.col("s").alias("concept"), F.col("o").alias("scheme")).distinct()


def members(triples: DataFrame) -> DataFrame:
    return schemes(triples).groupBy("scheme").agg(F.array_sort(F.collect_set("concept")).alias("members"))


def closure(edges: DataFrame) -> DataFrame:
    """(low, high) of the transitive closure of a child-parent relation, by doubling joins.

    Paths double in length every round, so a hierarchy of depth d takes log2(d) rounds; it ends, on
    cycles too, when nothing new is found.
    """
    known = edges.select("low", "high").where("low is not null and high is not null").distinct()
    before = -1
    while True:
        longer = known.alias("a").join(known.alias("b"), F.col("a.high") == F.col("b.low")).select("a.low", "b.high")
        known = cut(known.unionByName(longer).distinct())
        now = known.count()
        if now == before:
            return known
        before = now


def project(coded: DataFrame, triples: DataFrame) -> DataFrame:
    """Sorted concepts, labels and evaluated properties of each reference.

    ``coded``: reference_id, property, concept, status. A concept counts if its status is coded
    or absent; a property is evaluated regardless.
    """
    counts = F.col("status").isNull() | (F.col("status") == "coded")
    named = coded.join(labels(triples), "concept", "left")
    return named.groupBy("reference_id").agg(
        F.array_sort(F.collect_set(F.when(counts, F.col("concept")))).alias("concepts"),
        F.array_sort(F.collect_set(F.when(counts, F.col("label")))).alias("labels"),
        F.array_sort(F.collect_set("property")).alias("evaluated"),
    )


def _of(triples: DataFrame, p: str, s: str, o: str) -> DataFrame:
    return triples.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o)).distinct()


def _typed(triples: DataFrame, kind: str, name: str) -> DataFrame:
    return triples.where((F.col("p") == TYPE) & (F.col("o") == kind)).select(F.col("s").alias(name)).distinct()


def properties(triples: DataFrame) -> DataFrame:
    """(scheme, property): object properties whose values are coded annotations with concepts of the scheme.

    A property's range is a coding annotation, and a subclass of a restriction whose coded values are of
    a class of concepts; those concepts lie in the scheme.
    """
    ranges = _of(triples, RANGE, "property", "annotation").join(_typed(triples, OBJECT_PROPERTY, "property"), "property", "left_semi")
    kinds = _of(triples, SUB_CLASS_OF, "annotation", "node")
    coding = kinds.where(F.col("node") == CODING_ANNOTATION).select("annotation")
    nodes = _of(triples, ON_PROPERTY, "node", "on").where(F.col("on") == CODED_VALUE).join(_of(triples, ALL_VALUES_FROM, "node", "value_class"), "node")
    concepts = _of(triples, TYPE, "concept", "value_class").join(schemes(triples), "concept").select("value_class", "scheme").distinct()
    return ranges.join(coding, "annotation", "left_semi").join(kinds, "annotation").join(nodes, "node").join(concepts, "value_class").select("scheme", "property").distinct()


def unwrapped_properties(triples: DataFrame) -> DataFrame:
    """(property): object properties whose values are concepts themselves, without an annotation around them.

    Their range is a concept scheme, or a class below the class of concepts that has a concept in a
    scheme, or that class itself if it has one.
    """
    ranges = _of(triples, RANGE, "property", "range").join(_typed(triples, OBJECT_PROPERTY, "property"), "property", "left_semi")
    below = closure(_of(triples, SUB_CLASS_OF, "low", "high")).where((F.col("high") == CONCEPT) & (F.col("low") != CONCEPT)).select(F.col("low").alias("range"))
    in_use = _of(triples, TYPE, "concept", "range").join(schemes(triples), "concept", "left_semi").select("range").distinct()
    top = in_use.where(F.col("range") == CONCEPT)
    fitting = _typed(triples, CONCEPT_SCHEME, "range").unionByName(below.join(in_use, "range", "left_semi")).unionByName(top)
    return ranges.join(fitting.distinct(), "range", "left_semi").select("property").distinct()


def project_discovered(values: DataFrame, triples: DataFrame) -> DataFrame:
    """Sorted concepts, labels and evaluated properties of every reference, by what the vocabulary says of itself.

    ``values``: reference_id, property, concept, status, wrapped, as of :func:`coded_rows`. Only concepts of the
    vocabulary count. A wrapped one counts if its status is coded or absent, and evaluates the property of its
    scheme in any case; one that stands alone counts, and evaluates its own property, if that is an unwrapped one.
    """
    known = values.join(_typed(triples, CONCEPT, "concept"), "concept").join(labels(triples), "concept", "left")
    by_concept = schemes(triples).join(properties(triples).withColumnRenamed("property", "scheme_property"), "scheme").groupBy("concept").agg(F.collect_set("scheme_property").alias("scheme_properties"))
    bare = unwrapped_properties(triples).withColumn("bare", F.lit(True))
    rows = known.join(by_concept, "concept", "left").join(bare, "property", "left")
    alone = ~F.col("wrapped") & F.coalesce("bare", F.lit(False))
    counts = alone | (F.col("wrapped") & (F.col("status").isNull() | (F.col("status") == "coded")))
    evaluated = F.when(alone, F.array("property")).when(F.col("wrapped"), F.col("scheme_properties"))
    kept = rows.select("reference_id", F.when(counts, F.col("concept")).alias("concept"), F.when(counts, F.col("label")).alias("label"), evaluated.alias("evaluated"))
    found = kept.groupBy("reference_id").agg(F.array_sort(F.collect_set("concept")).alias("concepts"), F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("evaluated")))).alias("evaluated"))
    none = F.array().cast("array<string>")
    return values.select("reference_id").distinct().join(found, "reference_id", "left").withColumns({c: F.coalesce(c, none) for c in ("concepts", "labels", "evaluated")})


def coded_rows(documents: DataFrame) -> DataFrame:
    """(reference_id, property, concept, literal, status, wrapped) of linked-data JSON texts (reference_id, data).

    ``data`` is an object of properties, each a value or an array of values. A value is an envelope
    of a coded annotation, {"status", "value"}, or stands alone; values are {"@id"} for concepts
    and {"@value"} or plain text for literals. What isn't JSON has no rows.
    """
    maps = documents.select("reference_id", F.explode(F.from_json("data", "map<string, string>")).alias("property", "raw")).where("raw is not null")
    items = F.when(F.col("raw").rlike(r"(?s)^\s*\["), F.from_json("raw", "array<string>")).otherwise(F.array("raw"))
    each = maps.select("reference_id", "property", F.explode(items).alias("item"))
    field = lambda path: F.get_json_object("item", path)
    alone = ~F.col("item").rlike(r"(?s)^\s*\{")
    literal = F.when(alone, F.col("item")).otherwise(F.coalesce(field("$.value['@value']"), field("$['@value']"), F.when(~field("$.value").rlike(r"(?s)^\s*\{"), field("$.value"))))
    return each.select("reference_id", "property", F.when(~alone, F.coalesce(field("$.value['@id']"), field("$['@id']"))).alias("concept"), literal.alias("literal"), F.when(~alone, field("$.status")).alias("status"), F.coalesce(field("$.value").isNotNull() & ~alone, F.lit(False)).alias("wrapped"))


def countries(coded: DataFrame, registered: list[str]) -> DataFrame:
    """(reference_id, countries): upper-cased literals of the registered properties, coded or without a status."""
    code = F.upper(F.trim("literal"))
    used = F.col("property").isin(*registered) & (F.col("status").isNull() | (F.col("status") == "coded")) & (F.length(code) > 0)
    return coded.where(used).groupBy("reference_id").agg(F.array_sort(F.collect_set(code)).alias("countries"))


def regions_of(countries_by_id: DataFrame, regions: DataFrame) -> DataFrame:
    """(reference_id, regions) of country arrays by a table (country, region); unknown countries have none."""
    each = countries_by_id.select("reference_id", F.explode("countries").alias("country"))
    return each.join(regions.select("country", "region"), "country").groupBy("reference_id").agg(F.array_sort(F.collect_set("region")).alias("regions"))


def violations(subjects: DataFrame, triples: DataFrame, required: list[str]) -> DataFrame:
    """(s, p) of required properties that a subject lacks."""
    wanted = subjects.select("s").distinct().select("s", F.explode(F.array(*[F.lit(p) for p in required])).alias("p"))
    return wanted.join(triples.select("s", "p"), ["s", "p"], "left_anti")


@dataclass(frozen=True)
class Shape:
    """What nodes of a class must hold: of a path at least ``least`` values, each of a class or an IRI; or, with
    ``either``, a value of one of several paths."""

    target: str
    path: str = ""
    least: int = 0
    value_class: str | None = None
    iri: bool = False
    either: tuple[str, ...] = ()


#: The structural shapes of linked data, in the names of the evidence vocabulary.
CORE_SHAPES = [
    Shape("LinkedDataEnhancement", "hasInvestigation", least=1, value_class="Investigation"),
    Shape("Investigation", "hasFinding", value_class="Finding"),
    Shape("Investigation", "hasAppliedConcept", value_class=CONCEPT, iri=True),
    Shape("Finding", either=("hasContext", "hasOutcome", "hasEffectEstimate", "evaluates", "comparedTo", "hasArmData")),
    Shape("Finding", "hasContext", value_class="Context"),
    Shape("Finding", "hasOutcome", value_class="Outcome"),
    Shape("Finding", "evaluates", value_class="Condition"),
    Shape("Finding", "comparedTo", value_class="Condition"),
    Shape("Finding", "hasArmData", value_class="ObservedResult"),
    Shape("Finding", "hasEffectEstimate", value_class="EffectEstimate"),
    Shape("ObservedResult", "forCondition", value_class="Condition"),
    Shape("EffectEstimate", "derivedFrom", value_class="ObservedResult"),
    Shape("EffectEstimate", "forOutcome", value_class="Outcome"),
    Shape("EffectEstimate", "effectSizeMetric", value_class="EffectSizeMetricConcept"),
    Shape("EffectEstimate", "estimateSource", value_class="EstimateSourceConcept"),
]


def shape_violations(triples: DataFrame, ontology: DataFrame, shapes: list[Shape] = CORE_SHAPES) -> DataFrame:
    """(graph, s, path, kind, n) of what nodes lack: kind is minCount, class, nodeKind or or.

    ``triples``: graph, s, p, o, iri (whether o is one); ``ontology`` (s, p, o) is part of every graph. A node is of a
    class if its type is, or lies below it. The shapes are a broadcast table by path, which values meet first, so
    that a node has a row for each value that some shape asks for and one for each shape that asks for some value;
    both are counted in one aggregation. ``n`` is the number of values in fault, or of those missing.
    """
    spark = triples.sparkSession
    full = lambda name: name if "://" in name else EVIDENCE + name
    rules = [(i, full(x.target), full(p), x.least, full(x.value_class) if x.value_class else None, x.iri, bool(x.either)) for i, x in enumerate(shapes) for p in (x.either or (x.path,))]
    columns = ["rule", "target", "path", "least", "value_class", "wants_iri", "either"]
    table = spark.createDataFrame(rules, "rule int, target string, path string, least int, value_class string, wants_iri boolean, either boolean")
    asking = spark.createDataFrame(list({r[0]: r for r in rules if r[3] > 0 or r[6]}.values()), table.schema)
    used = spark.createDataFrame(sorted({(k,) for r in rules for k in (r[1], r[4]) if k}), "kind string")
    classes = ontology.where((F.col("p") == SUB_CLASS_OF) & F.col("o").contains("://")).select(F.col("s").alias("low"), F.col("o").alias("high"))
    # Written, so that their true sizes decide how they are joined.
    above = lineage.stored(closure(classes), "classes")
    fixed = ontology.where(F.col("p") == TYPE).select(F.col("s").alias("o"), F.col("o").alias("kind"))
    fixed = lineage.stored(fixed.unionByName(fixed.join(above, fixed["kind"] == above["low"]).select("o", F.col("high").alias("kind"))).distinct(), "typed")
    types = triples.where(F.col("p") == TYPE).select("graph", F.col("s").alias("node"), F.col("o").alias("kind"))
    types = types.unionByName(types.join(above, types["kind"] == above["low"]).select("graph", "node", F.col("high").alias("kind")))
    types = types.join(F.broadcast(used), "kind", "left_semi").distinct()
    values = triples.where("o is not null").select("graph", "s", F.col("p").alias("path"), "o", "iri").join(F.broadcast(table.select("path")), "path", "left_semi").distinct()
    nodes = types.select("graph", F.col("node").alias("s"), F.col("kind").alias("target"))
    held = values.join(F.broadcast(table), "path").join(nodes, ["graph", "s", "target"], "left_semi").select("graph", "s", "o", "iri", *columns)
    own = types.select("graph", F.col("node").alias("o"), F.col("kind").alias("value_class"), F.lit(True).alias("own"))
    known = fixed.select("o", F.col("kind").alias("value_class"), F.lit(True).alias("known"))
    held = held.join(own, ["graph", "o", "value_class"], "left").join(known, ["o", "value_class"], "left")
    held = held.unionByName(nodes.join(F.broadcast(asking), "target"), allowMissingColumns=True)
    there = F.col("o").isNotNull()
    fits = F.col("value_class").isNull() | F.coalesce("own", "known", F.lit(False))
    group = F.when(~F.col("either"), F.col("path"))
    counted = held.groupBy("graph", "s", "rule", group.alias("path")).agg(
        F.max("least").alias("least"),
        F.bool_or("either").alias("either"),
        F.count_if(there).alias("there"),
        F.count_if(there & ~fits).alias("unfit"),
        F.count_if(there & F.col("wants_iri") & ~F.col("iri")).alias("plain"),
    )
    faults = F.array(
        F.struct(F.lit("minCount").alias("kind"), F.greatest(F.col("least") - F.col("there"), F.lit(0)).alias("n")),
        F.struct(F.lit("class").alias("kind"), F.when(F.col("either"), 0).otherwise(F.col("unfit")).alias("n")),
        F.struct(F.lit("nodeKind").alias("kind"), F.col("plain").alias("n")),
        F.struct(F.lit("or").alias("kind"), F.when(F.col("either") & (F.col("there") == 0), 1).otherwise(0).cast("long").alias("n")),
    )
    each = counted.select("graph", "s", F.regexp_replace("path", f"^{EVIDENCE}", "").alias("path"), F.explode(faults).alias("fault"))
    return each.select("graph", "s", "path", "fault.kind", F.col("fault.n").cast("long").alias("n")).where("n > 0")
