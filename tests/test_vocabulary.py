"""Property discovery and shapes on a vocabulary of the kind that they are made for."""

from __future__ import annotations

from quillspark.operators import vocabulary as v

E = v.EVIDENCE


def triples(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string")


VOCABULARY = [
    ("theme", v.TYPE, v.OBJECT_PROPERTY),
    ("theme", v.RANGE, "ThemeAnnotation"),
    ("ThemeAnnotation", v.SUB_CLASS_OF, v.CODING_ANNOTATION),
    ("ThemeAnnotation", v.SUB_CLASS_OF, "_:restriction"),
    ("_:restriction", v.ON_PROPERTY, v.CODED_VALUE),
    ("_:restriction", v.ALL_VALUES_FROM, "ThemeConcept"),
    ("reading", v.TYPE, "ThemeConcept"),
    ("reading", v.TYPE, v.CONCEPT),
    ("reading", v.IN_SCHEME, "ThemeScheme"),
    ("reading", v.PREF_LABEL, "Reading"),
    # Not a property; a class without a coding annotation; a restriction on something else.
    ("no property", v.RANGE, "ThemeAnnotation"),
    ("loose", v.TYPE, v.OBJECT_PROPERTY),
    ("loose", v.RANGE, "LooseAnnotation"),
    ("LooseAnnotation", v.SUB_CLASS_OF, "_:restriction"),
    ("other", v.TYPE, v.OBJECT_PROPERTY),
    ("other", v.RANGE, "OtherAnnotation"),
    ("OtherAnnotation", v.SUB_CLASS_OF, v.CODING_ANNOTATION),
    ("OtherAnnotation", v.SUB_CLASS_OF, "_:other"),
    ("_:other", v.ON_PROPERTY, "status"),
    ("_:other", v.ALL_VALUES_FROM, "ThemeConcept"),
    # Unwrapped: by scheme, by a class two steps below the class of concepts, by that class itself.
    ("by scheme", v.TYPE, v.OBJECT_PROPERTY),
    ("by scheme", v.RANGE, "ThemeScheme"),
    ("ThemeScheme", v.TYPE, v.CONCEPT_SCHEME),
    ("by class", v.TYPE, v.OBJECT_PROPERTY),
    ("by class", v.RANGE, "ThemeConcept"),
    ("ThemeConcept", v.SUB_CLASS_OF, "MiddleConcept"),
    ("MiddleConcept", v.SUB_CLASS_OF, v.CONCEPT),
    ("by middle", v.TYPE, v.OBJECT_PROPERTY),
    ("by middle", v.RANGE, "MiddleConcept"),
    ("by concept", v.TYPE, v.OBJECT_PROPERTY),
    ("by concept", v.RANGE, v.CONCEPT),
]


def test_properties_are_found_by_their_ranges(spark):
    graph = triples(spark, VOCABULARY)
    assert [tuple(r) for r in v.properties(graph).collect()] == [("ThemeScheme", "theme")]
    # No concept is of the middle class itself.
    assert {r[0] for r in v.unwrapped_properties(graph).collect()} == {"by scheme", "by class", "by concept"}
    lone = triples(spark, [t for t in VOCABULARY if t[1] != v.IN_SCHEME])
    assert v.properties(lone).count() == 0 and {r[0] for r in v.unwrapped_properties(lone).collect()} == {"by scheme"}


def test_values_are_projected_by_what_the_vocabulary_says(spark):
    data = [
        (1, '{"x": {"status": "coded", "value": {"@id": "reading"}}}'),
        (2, '{"x": {"status": "not_coded", "value": {"@id": "reading"}}}'),
        (3, '{"by class": [{"@id": "reading"}], "loose": {"@id": "reading"}}'),
        (4, '{"x": {"value": {"@id": "unknown"}}, "loose": {"@id": "reading"}}'),
    ]
    found = v.project_discovered(v.coded_rows(spark.createDataFrame(data, "reference_id long, data string")), triples(spark, VOCABULARY)).collect()
    assert {r["reference_id"]: tuple(r)[1:] for r in found} == {1: (["reading"], ["Reading"], ["theme"]), 2: ([], [], ["theme"]), 3: (["reading"], ["Reading"], ["by class"]), 4: ([], [], [])}


def test_shapes_count_faults_of_every_kind(spark):
    rows = [
        ("e", v.TYPE, E + "LinkedDataEnhancement"),
        ("i", v.TYPE, E + "Investigation"),
        ("i", E + "hasFinding", "f"),
        ("i", E + "hasFinding", "no finding"),
        ("i", E + "hasAppliedConcept", "reading"),
        ("f", v.TYPE, "SpecialFinding"),
        ("f", E + "evaluates", "c"),
        ("c", v.TYPE, E + "Context"),
        ("g", v.TYPE, E + "Finding"),
    ]
    data = spark.createDataFrame([(graph, *r, r[2] != "reading" or graph == 1) for graph in (1, 2) for r in rows] + [(2, "e", E + "hasInvestigation", "i", True)], "graph long, s string, p string, o string, iri boolean")
    ontology = triples(spark, [*VOCABULARY, ("SpecialFinding", v.SUB_CLASS_OF, E + "Finding")])
    both = {("i", "hasFinding", "class", 1), ("f", "evaluates", "class", 1), ("g", None, "or", 1)}
    found = {(r["graph"], *tuple(r)[1:]) for r in v.shape_violations(data, ontology).collect()}
    assert found == {(g, *x) for g in (1, 2) for x in both} | {(1, "e", "hasInvestigation", "minCount", 1), (2, "i", "hasAppliedConcept", "nodeKind", 1)}
    # A type in another graph is none in this one.
    assert v.shape_violations(data.where("graph = 1 or p <> '%s'" % v.TYPE), ontology).where("graph = 2").count() == 0
