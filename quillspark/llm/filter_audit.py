"""Audit of five document filters: what each removes, alone and in every order of application.

A document's failures are the bits of one mask, so all orders follow from counts by mask:

1. Sort: rows are cut into ranges of (text fingerprint, doc_id) and sorted by fingerprint, full text
   and doc_id, so equal texts are neighbours. A row repeats a text if a row of the same text before it
   has a smaller doc_id. The ranges' bounds travel through the driver, so they hold numbers only;
   a group of copies may lie in many ranges, however large it is.
2. Boundaries: what the first fingerprint of a range has in the ranges before it is unknown there.
   Each range reports its last fingerprint's texts as (digest, least doc_id); carried on from range
   to range, a few numbers each, these settle the open rows.
3. Counters: masks are counted by part together with the labels, and the counts are summed up
   for every set of filters applied before a filter, then laid out by order and step.

Null texts count as empty, null parts as ''. Rows without a doc_id repeat nothing and nothing
repeats them; rows of one doc_id and text don't repeat each other. Every row counts as a document.
Several labels of a doc_id count as 1 if any is 1. Extra columns are ignored; no rows give none.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import durable, lean, text_batches

#: The filters' letters; filter i is bit i of a mask.
LETTERS = "ABCDE"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SIGNS = b"#$%&*|"
REPEATED = 1 << LETTERS.index("E")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of UTF-8 that continue a character.
_CONTINUING = bytes(range(0x80, 0xC0))
_JUDGED = "kind string, pid int, doc_id long, part string, mask int, digest binary, first_fp long, last_fp long"
_JUDGED_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64())


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = text.split()
    few = len(words) < FEWEST_WORDS
    alike = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text.translate(None, _CONTINUING))
    signs = len(text.translate(None, SIGNS)) < len(text)
    return few | alike << 1 | loud << 2 | signs << 3


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, part, text, fp) of a range to masks, and what the next ranges must know.

    A row of the range's first fingerprint that has no smaller doc_id of its text in here is open:
    it carries its text's digest.
    """
    pid = TaskContext.get().partitionId()
    first_fp = fp = text = least = digest = None
    mask, groups, begun = 0, {}, False

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _JUDGED_TYPES)], names=[c.split()[0] for c in _JUDGED.split(", ")])

    for batch in batches:
        rows = []
        for doc_id, part, own, own_fp in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun:
                first_fp, begun = own_fp, True
            if own_fp != fp:
                fp, text, groups = own_fp, None, {}
            if own != text:
                text, least, mask = own, None, text_mask(own)
                digest = hashlib.sha256(own).digest() if own_fp == first_fp else None
            repeated = least is not None and doc_id is not None and doc_id > least
            if least is None and doc_id is not None:
                groups[own] = least = doc_id
            still_open = digest if doc_id is not None and not repeated else None
            rows.append(("row", pid, doc_id, part, mask | REPEATED * repeated, still_open, None, None))
        if rows:
            yield batch_of(rows)
    if begun:
        rows = [("range", pid, None, None, None, None, first_fp, fp)]
        rows += [("range", pid, low, None, None, hashlib.sha256(t).digest(), first_fp, fp) for t, low in groups.items()]
        yield batch_of(rows)


def _repeating(ranges: list) -> list[tuple[int, bytes, int]]:
    """(pid, digest, least doc_id before) of the texts that lie in ranges before ``pid`` too.

    ``ranges`` has a row for each range and one for each text of its last fingerprint, in order.
    """
    found, carried_fp, carried = [], None, {}
    for pid, rows in itertools.groupby(ranges, key=lambda r: r["pid"]):
        rows = list(rows)
        first, last = rows[0]["first_fp"], rows[0]["last_fp"]
        if carried and carried_fp == first:
            found += [(pid, digest, low) for digest, low in carried.items()]
        if carried_fp != last:
            carried = {}
        carried_fp = last
        for r in rows:
            if r["digest"] is not None:
                carried[r["digest"]] = min(r["doc_id"], carried.get(r["digest"], r["doc_id"]))
    return found


def failure_masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of every row: bit i of the mask is set if the row fails filter i."""
    spark = docs.sparkSession
    text_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.cast("binary").alias("text"), F.xxhash64(text).alias("fp"), F.monotonically_increasing_id().alias("tie"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "fp", "doc_id", "tie").sortWithinPartitions("fp", "text", "doc_id")
    judged = durable(ranged.select("doc_id", "part", "text", "fp").mapInArrow(lean(_judge), _JUDGED), "filter-masks", "kind")
    ranges = judged.where("kind = 'range'").select("pid", "doc_id", "digest", "first_fp", "last_fp").orderBy("pid", F.col("digest").asc_nulls_first()).collect()
    masks = judged.where("kind = 'row'").select("doc_id", "part", "mask", "pid", "digest")
    again = _repeating(ranges)
    if again:
        before = F.broadcast(spark.createDataFrame(again, "pid int, digest binary, low long"))
        masks = masks.join(before, ["pid", "digest"], "left").withColumn("mask", F.when(F.col("low") < F.col("doc_id"), F.col("mask").bitwiseOR(F.lit(REPEATED))).otherwise(F.col("mask")))
    return masks.select("doc_id", "part", "mask")


def audit(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every part, order of the filters and step, from (doc_id, part, mask) and labels.

    kept: after the step; removed: by it; redundant: fail its filter but went earlier; unique_fails: fail it
    alone; good_lost, toxic_lost: removed with quality 1, toxic 1; shapley: removed by the filter, over all orders.
    """
    spark = masks.sparkSession
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("long").alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic"))
    counts = masks.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"))
    bits = [1 << i for i in range(len(LETTERS))]
    orders = [("".join(LETTERS[i] for i in order), step + 1, sum(bits[i] for i in order[:step]), bits[order[step]]) for order in itertools.permutations(range(len(LETTERS))) for step in range(len(LETTERS))]
    n_orders = len(orders) // len(LETTERS)
    states = sorted({(before, bit) for _, _, before, bit in orders})
    each = F.explode(F.array(*[F.struct(F.lit(before).alias("before"), F.lit(bit).alias("bit")) for before, bit in states])).alias("state")
    spread = counts.select("part", "mask", "n", "good", "bad", each).select("*", "state.before", "state.bit")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, value, name: F.sum(F.when(when, value).otherwise(F.lit(0))).cast("long").alias(name)
    # Of the orders, one in as many as a mask has bits puts a given one of them first.
    share = (F.col("n") * n_orders / F.bit_count("mask")).cast("long")
    tallies = spread.groupBy("part", "before", "bit").agg(
        total(~fails & ~gone, F.col("n"), "kept"),
        total(fails & ~gone, F.col("n"), "removed"),
        total(fails & gone, F.col("n"), "redundant"),
        total(F.col("mask") == F.col("bit"), F.col("n"), "unique_fails"),
        total(fails & ~gone, F.col("good"), "good_lost"),
        total(fails & ~gone, F.col("bad"), "toxic_lost"),
        total(fails, share, "shapley"),
    )
    steps = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, before int, bit int"))
    return tallies.join(steps, ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
