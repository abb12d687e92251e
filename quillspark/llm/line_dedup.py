"""Line dedup by an exact set-similarity join; DataFrame functions only.

A line is the set of its lower-cased words. Every line whose set has Jaccard similarity of
``NUM / DEN`` or more with a line before it (by doc_id, then row, then line number) is removed, be
that line removed itself or not. Lines without words stay.

1. Words are ordered by rarity: by the count of their hash bucket over all lines, in half octaves,
   then by hash. A line's prefix is its n - ceil(t n) + 1 rarest words: similar lines share a
   word of their prefixes.
2. Equal sets are first counted as one, at the place of the first.
3. Pivot rounds: lines that share two neighbouring words of their prefixes' first ``GROUP_WORDS``,
   or of those prefix words that are a large share of all words, make a group; every open line is compared with the likeliest of its groups' first open lines
   only, so a group of near copies costs a comparison a line and round, however large it is.
4. Prefix join: the lines not yet settled meet all earlier lines that share a prefix word, under
   the length filter, the positional filter, and a filter on the parity bitmaps of both sets
   (a differing bit proves a differing word), all inside the join condition. A line's likeliest
   partner is verified first, and the rest only of lines that are not similar to it.
5. Every round verifies the Jaccard similarity of the word sets themselves.

Rows are numbered in the order of (doc_id, row), so repeated ids and null ids, which come last,
are documents of their own. They lie in a table bucketed by row, so verification and removal move
places and single lines but no texts; a document is split once a round, however many of its lines
are asked for. Null and empty texts have no lines; extra columns pass through, whatever their
names; an empty table gives no rows. Two sets count as equal in step 2 if their words' hashes of
56 bits are.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import drop_table, durable, durable_bucketed, release

#: Jaccard similarity as a fraction.
NUM, DEN = 4, 5
#: Counts of so many hash buckets of words go to the driver and back, whatever the input.
RARITY_BUCKETS = 1 << 17
#: Prefix words whose neighbouring pairs group lines, and rounds of comparison with a pivot.
GROUP_WORDS, PIVOT_ROUNDS = 5, 3
#: A hash bucket with more than one in so many of all words is frequent, at any size of input.
FREQUENT_SHARE = 12_800
#: Lines of more words have bitmaps of 128 bits, whose halves' difference is the bitmap of 64 of others.
LONG_LINE = 56
BLANKS = r"[ \t\r\f\x0b]"
HASH_BITS = 56
#: What is known of a line besides its place and words.
FACTS = ["n", "bits", "more"]


def words_of(line: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(line), BLANKS), ""))


def _has_words(line: Column) -> Column:
    return line.rlike(BLANKS.replace("[", "[^"))


def _once(value: Column) -> Column:
    """A generator between two projections keeps a value from being computed for each use."""
    return F.explode(F.array(value))


class Rows:
    """Documents by row, and the order of their lines as one number: row number times a power of two."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs
        keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.octet_length(F.col("text").cast("string")).alias("size"), F.struct("*").alias("row"))
        # Dealt by key first, each task writes one bucket's file instead of one for every bucket.
        self.store = durable_bucketed(keyed.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key"), "line-store", "key")
        narrow = self.store.select("key", F.col("row.doc_id").cast("long").alias("doc_id"), "size")
        ordered = narrow.repartitionByRange(F.col("doc_id").asc_nulls_last(), "key").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "key")
        self.written = durable(ordered.select("key", "size", F.monotonically_increasing_id().alias("m")), "line-rows")
        at = F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
        parts, most, size = (x or 0 for x in self.written.agg(F.max(F.shiftright("m", 33)), F.max(at), F.max("size")).first())
        self.step = 1 << (size + 1).bit_length()
        self.kind = "long" if (parts + 1) * (most + 1) * self.step < 1 << 63 else "decimal(38,0)"
        self.numbers = self.written.select("key", (F.shiftright("m", 33) * F.lit(most + 1) + at).alias("number"))

    def place(self, number: Column, at: Column) -> Column:
        return (number.cast(self.kind) * F.lit(self.step).cast(self.kind) + at).cast(self.kind)

    def parts(self, place: Column) -> tuple[Column, Column]:
        """(row number, line number) of a place."""
        step = F.lit(self.step).cast(self.kind)
        number = F.call_function("div", place, step) if self.kind == "long" else F.floor(place / step)
        return number.cast("long"), F.pmod(place, step).cast("int")

    def gathered(self, places: DataFrame, name: str) -> DataFrame:
        """(key, number, ``name``): the line numbers of ``places`` by row."""
        number, at = self.parts(F.col("place"))
        lists = places.select(number.alias("number"), at.alias("at")).groupBy("number").agg(F.collect_list("at").alias(name))
        return lists.join(self.numbers, "number").hint("shuffle_hash")

    def words(self, places: DataFrame) -> DataFrame:
        """(place, words) of distinct ``places``; every row is split once."""
        there = self.store.select("key", F.col("row.text").cast("string").alias("text")).join(self.gathered(places, "at"), "key")
        split = there.select("number", _once(F.struct("at", F.split("text", "\n").alias("lines"))).alias("s"))
        lines = split.select("number", "s.lines", F.explode("s.at").alias("at"))
        return lines.select(self.place(F.col("number"), F.col("at")).alias("place"), words_of(F.get("lines", F.col("at"))).alias("words"))

    def drop(self) -> None:
        drop_table(self.store)
        release(self.written)


def rarity_classes(texts: DataFrame) -> tuple[Column, int]:
    """A constant array of ``RARITY_BUCKETS`` classes, half octaves of the buckets' word counts, and the least frequent class."""
    words = texts.select(F.explode(F.split(F.lower("text"), r"[ \t\r\f\x0b\n]+")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(RARITY_BUCKETS - 1)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    classes = ["0"] * RARITY_BUCKETS
    total = 0
    for bucket, n, octave in counts.select("bucket", "n", F.floor(2 * F.log2(1 + F.col("n").cast("double")))).collect():
        classes[bucket] = str(octave)
        total += n
    return F.split(F.lit(",".join(classes)), ",").cast("array<tinyint>"), ceil(2 * log2(1 + total / FREQUENT_SHARE))


def _bits(ranks: Column) -> Column:
    """A parity bitmap of 64 bits: each rank turns over the bit that its last six bits name."""
    turn = lambda r: F.call_function("shiftleft", F.lit(1).cast("long"), r.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(ranks, F.lit(0).cast("long"), lambda bits, r: bits.bitwiseXOR(turn(r)))


def _sets(rows: Rows, classes: Column, frequent: int) -> DataFrame:
    """place, size, bitmaps and two hashes of the word set of every line, its prefix, and the frequent words of that."""
    texts = rows.store.select("key", F.col("row.text").cast("string").alias("text")).join(rows.numbers.hint("shuffle_hash"), "key")
    lines = texts.select("number", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(_has_words(F.col("line")))
    hashes = F.array_distinct(F.array_remove(F.transform(F.split(F.lower("line"), BLANKS + "+"), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))
    held = lines.select(rows.place(F.col("number"), F.col("at")).alias("place"), _once(hashes).alias("h"))
    ranked = lambda h: F.shiftleft(classes[h.bitwiseAND(F.lit(RARITY_BUCKETS - 1))].cast("long"), HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))
    sets = held.select("place", _once(F.sort_array(F.transform("h", ranked))).alias("r")).withColumn("n", F.size("r"))
    length = F.col("n") - F.expr(f"({NUM} * n + {DEN - 1}) div {DEN}").cast("int") + 1
    # A long line's bitmap of 128 bits: ``more`` is that of some of its words, ``bits`` that of the rest.
    half = lambda h: _bits(F.filter("r", lambda r: F.shiftright(r, 6).bitwiseAND(F.lit(1)) == h))
    is_long = F.col("n") > LONG_LINE
    prefix = F.slice("r", F.lit(1), length)
    return sets.select("place", "n", F.when(is_long, half(0)).otherwise(_bits(F.col("r"))).alias("bits"), F.when(is_long, half(1)).otherwise(F.lit(0)).cast("long").alias("more"), F.xxhash64("r").alias("h1"), F.xxhash64(F.lit("set"), "r").alias("h2"), F.transform(prefix, lambda r: F.hash(r)).alias("prefix"), F.transform(F.filter(prefix, lambda r: F.shiftright(r, HASH_BITS) >= frequent), lambda r: F.hash(r)).alias("often"))


def _differing(a: str, b: str) -> Column:
    """How many parity bits differ: of 128 if both lines are long or both short, else of the 64 that both have."""
    left, right = (lambda c: F.col(a + c)), (lambda c: F.col(b + c))
    apart = F.bit_count(left("bits").bitwiseXOR(right("bits"))) + F.bit_count(left("more").bitwiseXOR(right("more")))
    folded = F.bit_count(left("bits").bitwiseXOR(left("more")).bitwiseXOR(right("bits")).bitwiseXOR(right("more")))
    return F.when((left("n") > LONG_LINE) == (right("n") > LONG_LINE), apart).otherwise(folded)


def _alike(a: str, b: str) -> Column:
    """What similar sets must fulfil: close sizes, and few differing parity bits."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (F.least(n, m) * DEN >= F.greatest(n, m) * NUM) & (_differing(a, b) * (NUM + DEN) <= (n + m) * (DEN - NUM))


def _verified(pairs: DataFrame, rows: Rows) -> DataFrame:
    """(place) of the first of each pair (a, b) of places whose word sets are similar enough; written."""
    words = durable(rows.words(pairs.select(F.explode(F.array("a", "b")).alias("place")).distinct()), "line-words")
    both = pairs.join(words.select(F.col("place").alias("a"), F.col("words").alias("x")), "a").join(words.select(F.col("place").alias("b"), F.col("words").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    found = durable(both.where(shared * (NUM + DEN) >= (F.size("x") + F.size("y")) * NUM).select(F.col("a").alias("place")), "similar-lines")
    release(words)
    return found


def _grouped(lines: DataFrame) -> DataFrame:
    """A row for each line and each of its groups that holds another line; written."""
    pairs = lambda words: F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
    word = lambda i: F.get("prefix", F.lit(i))
    first = F.array_compact(F.array(*(F.when(word(i + 1).isNotNull(), F.xxhash64(word(i), word(i + 1))) for i in range(GROUP_WORDS - 1))))
    groups = F.array_distinct(F.when(F.size("often") > 1, F.concat(first, pairs(F.col("often")))).otherwise(first))
    members = lines.select("place", *FACTS, F.explode(groups).alias("group"))
    shared = members.groupBy("group").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("group")
    return durable(members.join(shared, "group"), "line-groups")


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of a line and the likeliest of the first lines of its groups."""
    pivots = members.groupBy("group").agg(F.min("place").alias("b"), *(F.min_by(c, "place").alias(f"b_{c}") for c in FACTS))
    met = members.select("group", F.col("place").alias("a"), *(F.col(c).alias(f"a_{c}") for c in FACTS)).join(pivots, "group")
    likely = met.where((F.col("a") > F.col("b")) & _alike("a_", "b_"))
    return _likeliest(likely.select("a", "b", _differing("a_", "b_").alias("differing")))


def _likeliest(pairs: DataFrame) -> DataFrame:
    """(a, b) with the b of each a that the fewest bits tell from it."""
    return pairs.groupBy("a").agg(F.min_by("b", F.struct("differing", "b")).alias("b"))


def _prefix_pairs(lines: DataFrame, settled: DataFrame, rows: Rows) -> DataFrame:
    """(a, b, differing bits) of an open line and an earlier one that share a prefix word and pass all filters."""
    # One signed number for place and state, so that both sides of the join read one exchange:
    # positive for open lines, negative for settled ones.
    marked = lines.join(settled.distinct().withColumn("settled", F.lit(True)), "place", "left")
    code = F.when(F.col("settled").isNull(), F.col("place") + 1).otherwise(-F.col("place") - 1).cast(rows.kind)
    entries = marked.select(code.alias("code"), *FACTS, "prefix", F.posexplode("prefix").alias("i", "word"))
    entries = entries.select("code", *FACTS, "i", "word", F.get("prefix", F.col("i") - 1).alias("before"))
    left, right, col = entries.alias("l"), entries.alias("r"), F.col
    most = F.least("l.i", "r.i") + F.least(col("l.n") - col("l.i"), col("r.n") - col("r.i"))
    met = (
        (col("l.word") == col("r.word"))
        & (col("l.code") > F.abs(col("r.code")))
        # Where the words before are shared too, the pair has met there, under the same bounds.
        & F.coalesce(col("l.before") != col("r.before"), F.lit(True))
        & (most * (NUM + DEN) >= (col("l.n") + col("r.n")) * NUM)
        & _alike("l.", "r.")
    )
    place = lambda c: (F.abs(col(c)) - 1).cast(rows.kind)
    return left.join(right, met).select(place("l.code").alias("a"), place("r.code").alias("b"), _differing("l.", "r.").alias("differing")).distinct()


def _staying(rows: Rows) -> DataFrame:
    """(place) of the lines with words that stay."""
    every = _sets(rows, *rarity_classes(rows.docs.select(F.col("text").cast("string").alias("text"))))
    lines = durable(every.groupBy("h1", "h2").agg(F.min("place").alias("place"), *(F.first(c).alias(c) for c in [*FACTS, "prefix", "often"])).drop("h1", "h2"), "line-sets")
    members, settled = _grouped(lines), None
    for _ in range(PIVOT_ROUNDS):
        pairs = durable(_pivot_pairs(members if settled is None else members.join(settled, "place", "left_anti")), "pivot-pairs")
        found = _verified(pairs, rows)
        release(pairs)
        settled = found if settled is None else settled.unionByName(found)
    release(members)
    # A line that is similar to the likeliest line before it needs no other: one comparison each, however many it meets.
    pairs = durable(_prefix_pairs(lines, settled, rows), "line-pairs")
    likeliest = durable(_likeliest(pairs), "likely-pairs")
    found = _verified(likeliest, rows)
    rest = pairs.select("a", "b").join(found.withColumnRenamed("place", "a"), "a", "left_anti").join(likeliest, ["a", "b"], "left_anti")
    gone = settled.unionByName(found).unionByName(_verified(durable(rest, "other-pairs"), rows))
    release(pairs)
    release(likeliest)
    return lines.select("place").join(gone, "place", "left_anti")


def _marked(docs: DataFrame) -> DataFrame:
    """``row`` with all columns of ``docs``, its text and lines, and the numbers of those removed."""
    rows = Rows(docs)
    stay = rows.gathered(durable(_staying(rows), "lines-that-stay"), "stay").drop("number")
    marked = rows.store.select("key", "row", F.col("row.text").cast("string").alias("text")).join(stay, "key", "left").withColumn("lines", F.split("text", "\n"))
    none = F.array().cast("array<int>")
    worded = F.filter(F.transform("lines", lambda x, i: F.when(_has_words(x), i)), lambda i: i.isNotNull())
    return marked.withColumn("removed", F.coalesce(F.array_except(worded, F.coalesce("stay", none)), none))


def _remaining() -> Column:
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    return F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text (without the removed lines), n_lines, n_removed and removed (line numbers from 0)."""
    marked = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return marked.select("row.doc_id", _remaining().alias("text"), F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with the removed lines gone from ``text``."""
    marked = _marked(docs)
    return marked.select(*(_remaining().alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
