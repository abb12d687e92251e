"""Record linkage: exact supersets, trusted identifiers, ranked candidates, decisions.

Candidate retrieval is an equi join on an inverted index of title words, dealt by document, with BM25 sums
where the postings lie and a top-k window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import author_terms, sampled, tokens, year_decay
from quillspark.operators import lineage, nearwords

#: BM25 constants, title boost, share of title words that must match, tie breaker.
K1, B, TITLE_BOOST, MIN_MATCH, TIE = 1.2, 0.75, 2.0, 0.5, 0.1
#: Rows of queries' words met by documents' that a task sums up.
ROWS_A_TASK = 4_000_000
#: Queries, and canonicals, of one identifier whose pairs a task makes.
PAIR_BLOCK = 1_000
TRUSTED = ("doi", "pm_id", "open_alex")
TERMINAL = ("duplicate", "exact_duplicate", "canonical", "unsearchable")


@dataclass(frozen=True)
class RetrievalPolicy:
    name: str
    year_strategy: str
    requires_year: bool = True
    fuzzy_title: bool = True
    union_identifiers: bool = True

    def searchable(self, title: Column, authors: Column, year: Column) -> Column:
        core = (F.length(F.coalesce(title, F.lit(""))) > 0) & (F.size(F.coalesce(authors, F.array().cast("array<string>"))) > 0)
        return core if not self.requires_year else core & (F.coalesce(year, F.lit(0)) != 0)


#: The retrieval policies by name.
POLICIES = {
    p.name: p
    for p in (
        RetrievalPolicy("current_fuzzy_v1", "hard_window"),
        RetrievalPolicy("no_year_filter_v1", "no_filter"),
        RetrievalPolicy("no_year_filter_year_optional_v1", "no_filter", requires_year=False),
        RetrievalPolicy("soft_year_decay_v1", "soft_decay"),
        RetrievalPolicy("soft_year_decay_year_optional_v1", "soft_decay", requires_year=False),
        RetrievalPolicy("soft_year_decay_nonfuzzy_probe_v1", "soft_decay", fuzzy_title=False),
        RetrievalPolicy("candidate_selection_v1", "soft_decay", fuzzy_title=False),
    )
}


def identifier_groups(identifiers: DataFrame, key: str = "reference_id") -> DataFrame:
    """Groups of references with the very same identifier set: canonical (least id), n_members."""
    sets = identifiers.groupBy(key).agg(F.array_sort(F.collect_set(F.concat_ws(":", "identifier_type", "identifier"))).alias("ids"))
    return sets.groupBy("ids").agg(F.min(key).alias("canonical"), F.count(F.lit(1)).alias("n_members")).where("n_members > 1")


def find_by_identifiers(identifiers: DataFrame, lookups: DataFrame, match: str = "any", key: str = "reference_id") -> DataFrame:
    """References that hold any, or all, of the looked-up (identifier_type, identifier, other name).

    Null other names equal each other; no lookups find nothing.
    """
    wanted = lookups.select("identifier_type", "identifier", "other_identifier_name").distinct()
    a, b = identifiers.alias("a"), wanted.alias("b")
    same = (F.col("a.identifier_type") == F.col("b.identifier_type")) & (F.col("a.identifier") == F.col("b.identifier")) & F.col("a.other_identifier_name").eqNullSafe(F.col("b.other_identifier_name"))
    if match == "any":
        return a.join(b, same, "left_semi").select(key).distinct()
    found = a.join(b, same).select(key, "b.identifier_type", "b.identifier", "b.other_identifier_name").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return found.join(F.broadcast(wanted.agg(F.count(F.lit(1)).alias("n"))), "n").select(key)


#: A content, its hash first, so that sorting seldom compares the sets themselves.
_CONTENT = ["mark", "visibility", "identifiers", "fingerprints"]


def _contents(df: DataFrame, *cols) -> DataFrame:
    """``cols`` and the visibility, identifiers and fingerprints as sorted sets, with a hash; rows that lack one can't match."""
    whole = df.where("reference_id is not null and visibility is not null and identifiers is not null and fingerprints is not null")
    sets = whole.select(*cols, "visibility", *(F.sort_array(F.array_distinct(c)).alias(c) for c in _CONTENT[2:]))
    return sets.withColumn("mark", F.xxhash64(*_CONTENT[1:]))


def _keyed(contents: DataFrame, name: str) -> DataFrame:
    """The contents in files, with a number ``name``, hashes of what they hold, a bit for each of those and a count.

    Whoever holds all of another has all of its bits.
    """
    hashed = lambda c, kind: F.transform(c, lambda x: F.xxhash64("visibility", F.lit(kind), x))
    keys = F.array_distinct(F.concat(hashed("identifiers", 0), hashed("fingerprints", 1)))
    bits = F.expr("aggregate(keys, 0L, (all, k) -> all | shiftleft(1L, cast(k & 63 AS int)))")
    size = F.size("identifiers") + F.size("fingerprints")
    return lineage.stored(contents.withColumn("keys", keys).select(F.monotonically_increasing_id().alias(name), "*", bits.alias("bits"), size.alias("size")), "contents")


def _best_two(rows: DataFrame, *of: str) -> DataFrame:
    """For every group its two first candidates by (place, candidate_id), as the array ``best``."""
    order = Window.partitionBy(*of).orderBy("place", "candidate_id")
    once = rows.groupBy(*of, "candidate_id").agg(F.min("place").alias("place"))
    top = once.withColumn("r", F.row_number().over(order)).where("r <= 2")
    both = F.struct("place", "candidate_id")
    return top.groupBy(*of).agg(F.array_distinct(F.array(F.min(both), F.max(both))).alias("best"))


def exact_duplicates(incoming: DataFrame, corpus: DataFrame) -> DataFrame:
    """(reference_id, candidate_id) where the candidate holds all that the incoming record holds.

    Both: reference_id, visibility, identifiers array<struct<identifier_type, identifier>>,
    fingerprints array<string>; corpus also duplicate_determination. Only records with an
    identifier other than ``other`` are looked up; canonical candidates come first, then least id.

    Records of equal content are compared once, with their two first candidates (a record is none
    of its own), and each content looks up only the identifier or fingerprint that the fewest
    contents of the corpus hold, as whoever holds all of them holds that one. Only numbers and bits
    meet there; the sets themselves are compared where the bits of one lie in another's.
    """
    usable = F.size(F.filter("identifiers", lambda x: x["identifier_type"] != "other")) > 0
    new = _contents(incoming, "reference_id").where(usable)
    canonical = F.col("duplicate_determination") == "canonical"
    place = F.when(canonical, 0).when(~canonical, 1).otherwise(2).alias("place")
    # Hashes only find candidates; those are compared as sets.
    stock = _keyed(_best_two(_contents(corpus, F.col("reference_id").alias("candidate_id"), place), *_CONTENT), "holder")
    asks = _keyed(new.select(*_CONTENT).distinct(), "asked")
    each = F.explode("keys").alias("key")
    holders = stock.select(each).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    probe = asks.select("asked", "bits", "size", each).join(holders, "key", "left")
    rarest = probe.groupBy("asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("rarest"), *(F.first(c).alias(c) for c in ("bits", "size")))
    index = stock.select("holder", each, F.col("bits").alias("bits2"), F.col("size").alias("size2"))
    within = (F.col("size") < F.col("size2")) & (F.col("bits").bitwiseAND(F.bitwise_not("bits2")) == 0)
    pairs = rarest.where("rarest.n > 0").select("asked", "bits", "size", F.col("rarest.key").alias("key")).join(index, "key").where(within).select("asked", "holder")
    held = (F.col("visibility") == F.col("v2")) & (F.size(F.array_except("identifiers", "i2")) == 0) & (F.size(F.array_except("fingerprints", "f2")) == 0)
    sets = stock.select("holder", F.col("visibility").alias("v2"), F.col("identifiers").alias("i2"), F.col("fingerprints").alias("f2"), "best")
    met = pairs.join(asks.select("asked", *_CONTENT), "asked").join(sets, "holder").where(held).select("asked", F.explode("best").alias("c")).select("asked", "c.*")
    larger = _best_two(met, "asked").join(asks.select("asked", *_CONTENT), "asked").select(*_CONTENT, "best")
    # Those of equal content are the corpus's own; whoever holds more was looked up.
    ranked = new.join(stock.select(*_CONTENT, "best").unionByName(larger), _CONTENT).select("reference_id", F.explode("best").alias("c")).where("c.candidate_id <> reference_id")
    return ranked.groupBy("reference_id").agg(F.min("c").alias("c")).select("reference_id", "c.candidate_id")


def identifier_matches(lookups: DataFrame, identifiers: DataFrame, decisions: DataFrame, a_task: int = PAIR_BLOCK) -> DataFrame:
    """(query_id, canonical_id, identifier_type, identifier), each once, over trusted identifiers, duplicates resolved, self left out.

    All pairs of an identifier are made, as many as its queries times its canonicals. They are dealt to
    tasks as blocks of about ``a_task`` queries and as many canonicals, so no task makes a frequent identifier's alone.
    """
    from quillspark.operators.records import canonical_of

    trusted, by = F.col("identifier_type").isin(*TRUSTED), ["identifier_type", "identifier"]
    a = lookups.where(trusted).select("query_id", *by).distinct()
    # Holders are resolved before they are met: one row for all that a canonical stands for. The least and
    # the largest of them tell whether any is another than the query.
    held = canonical_of(identifiers.where(trusted).select("reference_id", *by), decisions)
    held = held.groupBy(*by, "canonical_id").agg(F.min("reference_id").alias("low"), F.max("reference_id").alias("high"))
    blocks = lambda rows, name: rows.where(trusted).groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / a_task).cast("int").alias(name))
    frequent = F.broadcast(blocks(lookups, "rows").join(blocks(identifiers, "columns"), by).where("rows > 1 or columns > 1"))
    # Each row has a block of its own side and meets all blocks of the other.
    own = lambda key, n: F.coalesce(F.pmod(F.xxhash64(key), n), F.lit(0)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    a = a.join(frequent, by, "left").select("query_id", *by, own("query_id", F.col("rows")).alias("row"), every(F.col("columns")).alias("column"))
    held = held.join(frequent, by, "left").select("canonical_id", "low", "high", *by, own("canonical_id", F.col("columns")).alias("column"), every(F.col("rows")).alias("row"))
    # A number of tasks of its own: by their bytes, which tell nothing of the pairs, small tables would get one.
    n_tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(n_tasks, *by, "row", "column")
    met = dealt(a).join(dealt(held), [*by, "row", "column"]).where("query_id <> canonical_id and (query_id <> low or query_id <> high)")
    return met.select("query_id", "canonical_id", *by)


def identifier_candidates(lookups: DataFrame, identifiers: DataFrame, decisions: DataFrame, a_task: int = PAIR_BLOCK) -> DataFrame:
    """(query_id, canonical_id, matched) over trusted identifiers, duplicates resolved, self left out."""
    met = identifier_matches(lookups, identifiers, decisions, a_task)
    return met.groupBy("query_id", "canonical_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "identifier_type", "identifier"))).alias("matched"))


def shortcut(matches: DataFrame) -> DataFrame:
    """Decision from trusted identifiers: (query_id, has_trusted, canonicals array) to determination.

    More than one canonical decouples, one makes a duplicate, none a canonical at once; without
    trusted identifiers there is no decision.
    """
    n = F.size("canonicals")
    return matches.where("has_trusted").select(
        "query_id",
        F.when(n > 1, "decoupled").when(n == 1, "duplicate").otherwise("canonical").alias("duplicate_determination"),
        F.when(n == 1, F.get("canonicals", F.lit(0))).alias("canonical_id"),
    )


@dataclass(frozen=True)
class TextStatistics:
    """Postings (id, word, tf, dl) of a text field, documents by word (word, df), and n_docs and avgdl in one row."""

    postings: DataFrame
    df: DataFrame
    totals: DataFrame


def count_words(docs: DataFrame, id_col: str, text_col: str) -> TextStatistics:
    index = inverted_index(docs, id_col, text_col)
    totals = docs.select(F.size(tokens(F.col(text_col))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    return TextStatistics(index, index.groupBy("word").agg(F.count(F.lit(1)).alias("df")), totals)


def inverted_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, word, tf, dl for every distinct word of a document."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ws"))
    return words.select("id", F.size("ws").alias("dl"), F.explode("ws").alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def bm25_top_k(queries: DataFrame, docs: DataFrame, k: int = 10, id_col: str = "id", text_col: str = "title", boost: float = TITLE_BOOST, year_col: str | None = None, fuzzy: bool = False, index: TextStatistics | None = None, skip_own: bool = True) -> DataFrame:
    """query_id, id, score (6 decimals), rank: the best documents by title words for each query.

    ``queries``: query_id (unique), text (and year); a document needs half of the query's distinct
    words, rounded down, but one at least. What a word counts in a document doesn't depend on the query, so it
    is worked out once for all queries that have the word. Postings are dealt by document before they meet the
    queries' words, so (query, document) pairs are formed and summed where they are and only those
    with enough words leave their task.
    With ``fuzzy`` a word is met by any of its near forms (:func:`nearwords.expansions`), whose scores add
    up; without, by itself. A query doesn't find the document of its own id, unless ``skip_own`` is
    false. ``index`` has the documents' postings and statistics ready, else they
    are counted here.
    """
    index = index or count_words(docs, id_col, text_col)
    year = ["year"] if year_col else []
    asked = queries.select("query_id", *year, F.array_distinct(tokens(F.col("text"))).alias("ws"))
    need = F.greatest(F.lit(1), F.floor(MIN_MATCH * F.size("ws")))
    words = asked.select("query_id", *year, need.alias("need"), F.explode("ws").alias("word"))
    if fuzzy:
        forms = nearwords.expansions(words.select("word").distinct(), index.df)
    else:
        forms = words.select("word").distinct().join(index.df, "word").withColumns({"variant": F.col("word"), "boost": F.lit(1.0), "own_df": F.col("df")})
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = forms.crossJoin(F.broadcast(index.totals)).select("word", "variant", (boost * F.col("boost") * idf).alias("weight"), "avgdl", "own_df")
    # Written, so that its true size decides how it is joined.
    weighed = lineage.stored(weighed, "word-forms")
    rows = weighed.join(words, "word").agg(F.sum("own_df")).first()[0] or 0
    tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))
    postings = index.postings.select("id", F.col("word").alias("variant"), "tf", "dl")
    dealt = postings.join(weighed.select("variant").distinct(), "variant", "left_semi").repartition(tasks, "id")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = dealt.join(weighed, "variant").groupBy("id", "word").agg(F.sum(part).alias("part"))
    met = hits.join(words, "word").groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("matched"), *(F.max(c).alias(c) for c in ("need", *year)))
    scored = met.where("matched >= need")
    if skip_own:
        scored = scored.where(~F.col("query_id").eqNullSafe(F.col("id")))
    if year_col:
        years = docs.select(F.col(id_col).alias("id"), F.col(year_col).alias("doc_year"))
        scored = scored.join(years, "id").withColumn("score", F.col("score") * year_decay(F.col("doc_year"), F.col("year")))
    scored = scored.select("query_id", "id", F.round("score", 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def dis_max(scores: Column, tie: float = TIE) -> Column:
    """The best of an array of scores plus a share of the others."""
    top = F.array_max(scores)
    return top + tie * (F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) - top)


@dataclass(frozen=True)
class CandidateSearch:
    """What to look for: a stored record by id, or title, authors and year given inline.

    ``excluded_id`` leaves a record out of an inline search; a stored one never finds itself.
    """

    policy: RetrievalPolicy
    k: int = 10
    most_authors: int = 25
    stored: bool = True

    def __post_init__(self) -> None:
        if not 1 <= self.k <= 1000:
            raise ValueError("k must be 1 to 1000")

    def usable(self, inputs: DataFrame) -> DataFrame:
        """Inputs with the reasons for which they can't be looked for, empty if they can."""
        blank = F.length(F.trim(F.coalesce("title", F.lit("")))) == 0
        lone = F.size(F.coalesce("authors", F.array().cast("array<string>"))) == 0
        undated = F.lit(self.policy.requires_year) & (F.coalesce("year", F.lit(0)) == 0)
        reasons = F.array_compact(F.array(F.when(blank, "no title"), F.when(lone, "no authors"), F.when(undated, "no year")))
        return inputs.withColumn("reasons", reasons)


def _author_scores(pairs: DataFrame, asked: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """(query_id, id, author_score): the best author's BM25 sum and a share of the others'."""
    names = docs.select("id", F.array_join("authors", " ").alias("names"))
    index = inverted_index(names, "id", "names")
    stats = names.select(F.size(tokens(F.col("names"))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = index.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    clauses = asked.select("query_id", F.posexplode(author_terms(F.col("authors"), cap=most)).alias("clause", "name"))
    words = clauses.select("query_id", "clause", F.explode(F.array_distinct(tokens(F.col("name")))).alias("word")).join(df, "word").crossJoin(F.broadcast(stats))
    met = pairs.join(words, "query_id").join(index, ["id", "word"])
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    by_clause = met.groupBy("query_id", "id", "clause").agg(F.sum(part).alias("s"))
    return by_clause.groupBy("query_id", "id").agg((F.max("s") + TIE * (F.sum("s") - F.max("s"))).alias("author_score"))


def ranked_candidates(inputs: DataFrame, docs: DataFrame, asked: CandidateSearch, index: TextStatistics | None = None) -> DataFrame:
    """query_id, id, score, rank of the best candidates of every input that can be looked for.

    ``inputs``: query_id, title, authors, year (and excluded_id, unless stored); ``docs``: id,
    title, authors, year, determination. Half of the title's distinct words must match, near words
    too if the policy is fuzzy; authors add to the score, and the year does as the policy says: within
    one year only, not at all, or a bonus that fades. A bonus needs both years. Only canonicals
    are candidates. Word statistics are of all of ``docs``, or those of a stored ``index`` of their titles.
    """
    usable = asked.usable(inputs).where(F.size("reasons") == 0)
    titles = bm25_top_k(usable.select("query_id", F.col("title").alias("text")), docs, k=1 << 30, fuzzy=asked.policy.fuzzy_title, index=index, skip_own=asked.stored)
    facts = docs.where("determination = 'canonical'").select("id", F.col("year").alias("doc_year"))
    own = usable.select("query_id", F.nullif("year", F.lit(0)).alias("year"), (F.col("query_id") if asked.stored else F.col("excluded_id")).alias("not_id"))
    met = titles.select("query_id", "id", F.col("score").alias("title_score")).join(facts, "id").join(own, "query_id").where(~F.col("id").eqNullSafe(F.col("not_id")))
    if asked.policy.year_strategy == "hard_window":
        met = met.where(F.abs(F.col("doc_year") - F.col("year")) <= 1)
    authors = _author_scores(met.select("query_id", "id"), usable, docs, asked.most_authors)
    base = F.col("title_score") + F.coalesce("author_score", F.lit(0.0))
    score = base * year_decay(F.col("doc_year"), F.col("year")) if asked.policy.year_strategy == "soft_decay" else base
    whole = met.join(authors, ["query_id", "id"], "left").select("query_id", "id", F.round(score, 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return whole.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= asked.k)


def diagnostics(ranked: DataFrame, k: int) -> DataFrame:
    """By query: how many candidates there are, whether k cut them, and the last and least scores."""
    return ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= k).alias("truncated"), F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth_score"), F.min("score").alias("lowest_score"))


def assess(candidates: DataFrame, papers: DataFrame, scorer, threshold: float) -> DataFrame:
    """Outcome of every query: each pair of papers is scored by ``scorer(a, b)``, a Column of two structs.

    ``candidates``: query_id, candidate_id (null: none); ``papers``: id and whatever the scorer
    reads; a candidate without a paper can't be scored.
    """
    fields = F.struct(*[c for c in papers.columns if c != "id"])
    a = papers.select(F.col("id").alias("query_id"), fields.alias("paper_a"))
    b = papers.select(F.col("id").alias("candidate_id"), fields.alias("paper_b"))
    both = candidates.join(a, "query_id", "left").join(b, "candidate_id", "left")
    missing = F.col("paper_a").isNull() | F.col("paper_b").isNull()
    scored = both.select("query_id", "candidate_id", F.when(~missing, scorer(F.col("paper_a"), F.col("paper_b"))).alias("probability"), F.col("paper_a").isNotNull().alias("searchable"))
    return outcome(scored, threshold)


def recorded(assessments: DataFrame, before: DataFrame, key: str, bits: int | None = None) -> DataFrame:
    """Rows to be recorded, those of ``before`` first; a payload stays where it is telling or sampled.

    ``assessments``: key (a uuid), outcome, payload. Proposals and failures are telling.
    """
    from quillspark.operators.relational import add_or_find

    keep = (F.col("outcome") != "propose_canonical") | F.coalesce(sampled(F.col(key), bits), F.lit(False))
    return add_or_find(before, assessments.withColumn("payload", F.when(keep, F.col("payload"))), key)


def merge_candidates(by_identifier: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row a canonical: those found by identifier only first, then by score; with all routes."""
    a = by_identifier.select("query_id", "canonical_id", F.lit(True).alias("by_identifier"))
    b = ranked.select("query_id", F.col("id").alias("canonical_id"), "score", F.lit(True).alias("by_search"))
    both = a.unionByName(b, allowMissingColumns=True).groupBy("query_id", "canonical_id").agg(F.coalesce(F.bool_or("by_identifier"), F.lit(False)).alias("by_identifier"), F.coalesce(F.bool_or("by_search"), F.lit(False)).alias("by_search"), F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.col("by_search"), F.col("score").desc_nulls_first(), "canonical_id")
    return both.withColumn("place", F.row_number().over(place))


def map_decision(rows: DataFrame, force: bool = False) -> DataFrame:
    """The action for a new decision against the active one, in this order.

    Columns new_determination, new_canonical, new_authority, active_determination,
    active_canonical, active_authority (nulls: none), has_duplicates. Adds determination, activate
    and changed. An active person's decision stands against the system's; a duplicate that would
    change is decoupled; a reference with duplicates cannot become one.
    """
    n, a = F.col("new_determination"), F.col("active_determination")
    other = (n == "canonical") | ((n == "duplicate") & ~F.col("new_canonical").eqNullSafe(F.col("active_canonical")))
    person = (F.col("active_authority") == "person") & (F.col("new_authority") == "system")
    case = F.when(F.lit(not force) & person, 1).when(F.lit(not force) & (a == "duplicate") & other, 2).when((n == "duplicate") & F.col("has_duplicates"), 3).otherwise(4)
    same = n.eqNullSafe(a) & F.col("new_canonical").eqNullSafe(F.col("active_canonical"))
    return rows.withColumn("case_", case).select(
        *rows.columns,
        F.when(F.col("case_") == 4, n).otherwise("decoupled").alias("determination"),
        (F.col("case_") == 4).alias("activate"),
        F.when(F.col("case_") == 1, False).when(F.col("case_") == 4, ~same).otherwise(True).alias("changed"),
    )


def invalid_decisions(rows: DataFrame) -> DataFrame:
    """Decisions that break the model, with the reason."""
    det = F.col("duplicate_determination")
    linked = det.isin("duplicate", "exact_duplicate")
    reason = (
        F.when(F.col("active_decision") & ~det.isin(*TERMINAL), "an active decision must be terminal")
        .when(linked & F.col("canonical_reference_id").isNull(), "a duplicate needs a canonical")
        .when(~linked & (det != "decoupled") & F.col("canonical_reference_id").isNotNull(), "only duplicates name a canonical")
        .when(F.col("canonical_reference_id") == F.col("reference_id"), "a reference duplicates itself")
    )
    return rows.withColumn("reason", reason).where("reason is not null")


def several_active(decisions: DataFrame) -> DataFrame:
    return decisions.where("active_decision").groupBy("reference_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def outcome(scored: DataFrame, threshold: float) -> DataFrame:
    """Assessment of scored candidates (query_id, searchable, candidate_id, probability) by query."""
    clear = F.count_if(F.col("probability") >= threshold)
    unscorable = F.count_if(F.col("candidate_id").isNotNull() & F.col("probability").isNull())
    return scored.groupBy("query_id").agg(
        clear.alias("n_clearing"),
        F.max("probability").alias("best"),
        F.when((unscorable > 0) | (clear > 1), "no_proposal").when(clear == 1, "propose_duplicate").when(F.bool_and("searchable"), "propose_canonical").otherwise("no_proposal").alias("outcome"),
    )
