"""Document search: predicates as Columns, two-valued like a search engine's.

There is no query-string language here; a query is composed of Column builders, which is what a
Spark user writes: ``any_term("title", "climate") & ~term("abstract", "policy")``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import tokens

#: Hits a search returns at most, and rows of a page; constants of BM25.
RESULT_WINDOW, PAGE_SIZE = 10_000, 20
BM25_K1, BM25_B = 1.2, 0.75


def sure(predicate: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(predicate, F.lit(False))


def term(column: str, word: str) -> Column:
    """The text field holds the word."""
    return sure(F.array_contains(tokens(F.col(column)), word.lower()))


def any_term(columns: list[str], word: str) -> Column:
    found = term(columns[0], word)
    for c in columns[1:]:
        found = found | term(c, word)
    return found


def prefix(column: str, start: str) -> Column:
    return sure(F.exists(tokens(F.col(column)), lambda t: t.startswith(start.lower())))


def wildcard(column: str, pattern: str) -> Column:
    """``*`` any run, ``?`` one character, over single words."""
    regex = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower())
    return sure(F.exists(tokens(F.col(column)), lambda t: t.rlike(f"^{regex}$")))


def fuzzy(column: str, word: str, edits: int | None = None) -> Column:
    """A word within so many edits; None takes 0 up to two letters, 1 up to five, else 2.

    Two neighbouring letters that change places are one edit.
    """
    word = word.lower()
    n = edits if edits is not None else 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2
    swapped = lambda words: sorted({w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in words for i in range(len(w) - 1)} - {word})
    near = [(word, n)] if n else []
    turned = [word]
    for left in range(n - 1, -1, -1):
        turned = swapped(turned)
        near += [(w, left) for w in turned]

    def close(t: Column) -> Column:
        found = t.isin([word] + [w for w, left in near if not left])
        for w, left in near:
            if left:
                found = found | (F.levenshtein(t, F.lit(w), left) >= 0)
        return found

    return sure(F.exists(tokens(F.col(column)), close))


def in_phrase(positions: dict[str, Column], words: list[str], slop: int) -> Column:
    """Whether one occurrence of each word lies at most ``slop`` places, over the whole phrase, off its order.

    ``positions`` has each distinct word's ascending positions in a text. A word's displacement is its position less its
    place in the phrase; the phrase fits if all displacements lie within ``slop`` of each other, so a
    word in between costs one, and neighbours that change places cost two. A word that the phrase
    has twice needs two occurrences.
    """
    places = {w: [i for i, x in enumerate(words) if x == w] for w in words}

    def from_low(low: Column) -> Column:
        def last(w: str) -> Column:
            # Places ascend and their ranges are equally long, so the first free position is the best for each.
            taken = lambda before, i: F.array_min(F.filter(positions[w], lambda p: (p > before) & (p >= low + i) & (p <= low + i + slop)))
            return F.aggregate(F.array(*map(F.lit, places[w])), F.lit(-1), taken)

        return reduce(lambda a, b: a & b, (last(w).isNotNull() for w in places))

    lows = F.array_distinct(F.flatten(F.transform(positions[words[0]], lambda p: F.sequence(p - slop, p))))
    return sure(F.exists(lows, from_low))


def phrase(column: str, words: str, slop: int = 0) -> Column:
    """The words in order and adjacent; with slop, within so many moves over the whole phrase (:func:`in_phrase`)."""
    wanted = [w.lower() for w in re.findall(r"\w+", words)]
    if not slop:
        regex = r"(?:^|\s)" + " ".join(re.escape(w) for w in wanted) + r"(?:\s|$)"
        return sure(F.array_join(tokens(F.col(column)), " ").rlike(regex))
    distinct = list(dict.fromkeys(wanted))
    places = lambda t, w: F.array_compact(F.transform(t, lambda x, i: F.when(x == w, i)))
    # Arrays of one item bind the words, then their places, to names, so that neither is worked out again.
    fits = lambda s: in_phrase({w: s[f"p{i}"] for i, w in enumerate(distinct)}, wanted, slop)
    placed = lambda t: F.exists(F.array(F.struct(*(places(t, w).alias(f"p{i}") for i, w in enumerate(distinct)))), fits)
    return sure(F.exists(F.array(tokens(F.col(column))), placed))


def exists(column: str) -> Column:
    return F.col(column).isNotNull()


def between(column: str, low=None, high=None) -> Column:
    """Inclusive range with optional bounds; null never fits."""
    found = F.col(column).isNotNull()
    if low is not None:
        found = found & (F.col(column) >= F.lit(low))
    if high is not None:
        found = found & (F.col(column) <= F.lit(high))
    return sure(found)


def holds(column: str, value: str) -> Column:
    """The keyword array holds exactly the value."""
    return sure(F.array_contains(column, value))


def holds_any(column: str, values: list[str]) -> Column:
    return sure(F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values])))


def annotation(scheme: str, label: str | None = None, score: float | None = None, columns: list[str] = ()) -> Column:
    """Scheme and label, scheme alone, or a least score in the scheme's own field.

    A score filter on a field that the documents lack fits nothing.
    """
    if score is not None:
        name = scheme.replace(":", "_") + (f"_{label}" if label else "")
        return between(name, low=score) if name in columns else F.lit(False)
    if label is not None:
        return holds("annotations", f"{scheme}/{label}")
    return sure(F.exists("annotations", lambda a: a.startswith(f"{scheme}/")))


@dataclass(frozen=True)
class Query:
    """A base predicate and named filters; facets leave their own filters out."""

    base: Column | None = None
    filters: tuple[tuple[str, Column], ...] = field(default=())

    def predicate(self, without: str | None = None) -> Column:
        out = self.base if self.base is not None else F.lit(True)
        for name, column in self.filters:
            if name != without:
                out = out & sure(column)
        return sure(out)


def order(keys: list[str], arrays: frozenset[str] = frozenset(), id_col: str = "id") -> list[Column]:
    """Sort keys: ``field`` ascending, ``-field`` descending, nulls last; ``relevance`` is best first
    and ``-relevance`` worst first; arrays sort by their least or greatest value; id breaks ties."""
    out = []
    for key in keys:
        down, name = key.startswith("-"), key.lstrip("+-")
        if name == "relevance":
            out.append(F.col("score_").asc_nulls_last() if down else F.col("score_").desc_nulls_last())
        else:
            c = (F.array_max(name) if down else F.array_min(name)) if name in arrays else F.col(name)
            out.append(c.desc_nulls_last() if down else c.asc_nulls_last())
    return [*out, F.col(id_col).desc()]


def search(docs: DataFrame, query: Query, sort: list[str] = (), page: int = 1, size: int = PAGE_SIZE, arrays: frozenset[str] = frozenset(), id_col: str = "id") -> DataFrame:
    """One page of hits; pages beyond the result window raise ValueError."""
    if page < 1 or page * size > RESULT_WINDOW:
        raise ValueError(f"page {page} of {size} is beyond {RESULT_WINDOW} hits")
    return docs.where(query.predicate()).orderBy(*order(list(sort), arrays, id_col)).offset((page - 1) * size).limit(size)


def count(docs: DataFrame, query: Query) -> DataFrame:
    return docs.where(query.predicate()).agg(F.count(F.lit(1)).alias("total"))


def capped_total(docs: DataFrame, query: Query) -> DataFrame:
    """total (at most the result window) and whether it is a lower bound."""
    n = F.count(F.lit(1))
    return docs.where(query.predicate()).agg(F.least(n, F.lit(RESULT_WINDOW)).alias("total"), (n > RESULT_WINDOW).alias("is_lower_bound"))


def scan(docs: DataFrame, query: Query, key: str, size: int = 500) -> DataFrame:
    """All hits with their page, in the order of a unique numeric key, without a global sort."""
    from quillspark.operators.relational import exact_rank

    if not 1 <= size <= RESULT_WINDOW:
        raise ValueError("page size must be 1 to 10000")
    ranked = exact_rank(docs.where(query.predicate()), key)
    return ranked.withColumn("page", F.expr(f"cast((rank_ - 1) div {size} + 1 as int)"))


def after(docs: DataFrame, query: Query, key: str, last, size: int) -> DataFrame:
    """The next page by key."""
    hits = docs.where(query.predicate())
    return (hits if last is None else hits.where(F.col(key) > F.lit(last))).orderBy(key).limit(size)


def scored(docs: DataFrame, words: str, columns: list[str], id_col: str = "id") -> DataFrame:
    """``docs`` with ``score_``: the best BM25 sum of the words over the columns, and 0 where no word is.

    Word statistics are of all of ``docs``; a document is split once, and only counts are gathered.
    """
    wanted = sorted(set(re.findall(r"\w+", words.lower())))
    if not wanted:
        return docs.withColumn("score_", F.lit(0.0))
    arrays = docs.withColumns({f"{c}_words_": tokens(F.col(c)) for c in columns})
    tf = lambda c, w: F.size(F.filter(f"{c}_words_", lambda t: t == w))
    counted = arrays.select(*docs.columns, *(F.size(f"{c}_words_").alias(f"{c}_n_") for c in columns), *(tf(c, w).alias(f"{c}_{i}_") for c in columns for i, w in enumerate(wanted)))
    stats = counted.agg(F.count(F.lit(1)).alias("docs_"), *(F.avg(f"{c}_n_").alias(f"{c}_avg_") for c in columns), *(F.count_if(F.col(f"{c}_{i}_") > 0).alias(f"{c}_{i}_df_") for c in columns for i in range(len(wanted))))
    rows = counted.crossJoin(F.broadcast(stats))

    def part(c: str, i: int) -> Column:
        n, df = F.col(f"{c}_{i}_").cast("double"), F.col(f"{c}_{i}_df_")
        idf = F.log(1 + (F.col("docs_") - df + 0.5) / (df + 0.5))
        return idf * n * (BM25_K1 + 1) / (n + BM25_K1 * (1 - BM25_B + BM25_B * F.col(f"{c}_n_") / F.nullif(F.col(f"{c}_avg_"), F.lit(0.0))))

    totals = [reduce(lambda a, b: a + b, (F.coalesce(part(c, i), F.lit(0.0)) for i in range(len(wanted)))) for c in columns]
    return rows.select(*docs.columns, F.round(F.greatest(*totals) if len(totals) > 1 else totals[0], 6).alias("score_"))


def search_ids(docs: DataFrame, query: Query, sort: list[str] = (), id_col: str = "id") -> DataFrame:
    """Ids of all hits within the result window, with their place."""
    by = order(list(sort), id_col=id_col)
    hits = docs.where(query.predicate()).orderBy(*by).limit(RESULT_WINDOW)
    return hits.withColumn("place", F.row_number().over(Window.orderBy(*by))).select(id_col, "place")


def hydrate(hits: DataFrame, records: DataFrame, key: str, by: list[Column]) -> DataFrame:
    """The first hits of the result window, in order, with their rank and records."""
    ranked = hits.orderBy(*by).limit(RESULT_WINDOW).withColumn("rank", F.row_number().over(Window.orderBy(*by)))
    return ranked.select(key, "rank").join(records, key)
