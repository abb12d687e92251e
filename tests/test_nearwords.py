"""Near words against the definition of their distance, and candidates by the policies' rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import linkage, nearwords


def distance(a, b):
    """Edits with neighbours that change places, which aren't edited again."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def allowed(word):
    return 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2


def some_words():
    rng = random.Random(17)

    def changed(word):
        word = list(word)
        for _ in range(rng.randint(0, 3)):
            i, kind = rng.randrange(len(word) - 1), rng.randrange(4)
            if kind == 0:
                word[i], word[i + 1] = word[i + 1], word[i]
            elif kind == 1:
                word.pop(i)
            elif kind == 2:
                word.insert(i, rng.choice("abcdé日"))
            else:
                word[i] = rng.choice("abcdé日")
        return "".join(word)

    short = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(400)}
    long = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (22, 23, 24, 25, 26, 27, 40, 61)]
    vocabulary = short | set(long) | {changed(w) for w in long for _ in range(12)}
    asked = set(rng.sample(sorted(vocabulary), 120)) | {changed(w) for w in long for _ in range(6)} | {"unheardof"}
    return asked, vocabulary


def test_near_words_against_the_distance_of_all_pairs(spark):
    asked, vocabulary = some_words()
    wanted = {(w, v, distance(w, v)) for w in asked for v in vocabulary if distance(w, v) <= allowed(w)}
    words = spark.createDataFrame([(w,) for w in [*asked, "", None]], "word string")
    found = nearwords.near_words(words, spark.createDataFrame([(v, 1) for v in [*vocabulary, "", None]], "word string, df long"))
    rows = [tuple(r) for r in found.select("word", "variant", "edits").collect()]
    assert set(rows) == wanted and len(rows) == len(wanted)


def test_forms_are_the_nearest_and_as_rare_as_the_commonest(spark):
    held = [("learning", 7), ("leaning", 2), ("lerning", 40), ("earnings", 9), ("burning", 3)]
    found = nearwords.expansions(spark.createDataFrame([("learning",)], "word string"), spark.createDataFrame(held, "word string, df long"), most=3).orderBy(F.desc("boost"), "variant").collect()
    assert [(r["variant"], round(r["boost"], 4), r["df"], r["own_df"]) for r in found] == [("learning", 1.0, 40, 7), ("leaning", 0.8571, 40, 2), ("lerning", 0.8571, 40, 40)]


DOCS = [
    (1, "machine learning for climate", ["ann smith"], 2000, "canonical"),
    (2, "machnie lerning for climate", ["ann smith"], 2004, "canonical"),
    (3, "machine learning for climate", ["ann smith"], 2030, "canonical"),
    (4, "machine learning for climate", ["ann smith"], 2000, "duplicate"),
    (5, "medical imaging review", ["bob jones"], 2000, "canonical"),
    (6, "machine learning for climate", ["ann smith"], None, "canonical"),
]


@pytest.mark.parametrize(
    ("policy", "year", "wanted"),
    [
        ("current_fuzzy_v1", 2000, {1}),
        ("no_year_filter_v1", 2000, {1, 2, 3, 6}),
        ("soft_year_decay_v1", 2000, {1, 2, 3, 6}),
        ("soft_year_decay_year_optional_v1", None, {1, 2, 3, 6}),
        ("soft_year_decay_nonfuzzy_probe_v1", 2000, set()),
        ("current_fuzzy_v1", None, set()),
    ],
)
def test_candidates_of_a_misspelt_title_by_policy(spark, policy, year, wanted):
    docs = spark.createDataFrame(DOCS, "id long, title string, authors array<string>, year int, determination string")
    asked = spark.createDataFrame([(99, "mahcine learnign fro climat", ["a smith"], year)], "query_id long, title string, authors array<string>, year int")
    found = linkage.ranked_candidates(asked, docs, linkage.CandidateSearch(linkage.POLICIES[policy])).orderBy("rank").collect()
    assert {r["id"] for r in found} == wanted
    if policy == "soft_year_decay_v1" and year:
        assert found[0]["id"] == 1 and {r["id"]: r["score"] for r in found}[3] > {r["id"]: r["score"] for r in found}[6]


def test_an_inline_search_leaves_its_excluded_record_out(spark):
    docs = spark.createDataFrame(DOCS, "id long, title string, authors array<string>, year int, determination string")
    asked = spark.createDataFrame([(1, "machine learning for climate", ["smith"], 2000, 3)], "query_id long, title string, authors array<string>, year int, excluded_id long")
    search = lambda stored: linkage.CandidateSearch(linkage.POLICIES["no_year_filter_v1"], stored=stored)
    assert {r["id"] for r in linkage.ranked_candidates(asked, docs, search(False)).collect()} == {1, 2, 6}
    assert {r["id"] for r in linkage.ranked_candidates(asked, docs, search(True)).collect()} == {2, 3, 6}
