"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, connected components.

Fingerprint: the text's A-Z are lower-cased, its words are runs of bytes other than ASCII white
space, and every run of ``SHINGLE_WORDS`` words (repeats included, joined by a space; the whole
sequence of a shorter text) is hashed by XXH64 with seed 42; a bit is 1 if it is set in more
than half of the hashes. Null texts and texts without words have fingerprint zero and link like
any other.

Two fingerprints link at ``MAX_BITS`` or fewer differing bits. The 64 bits are cut into more
blocks than that, so close pairs agree in all of some (blocks - MAX_BITS) blocks; each such
choice of blocks is a join key. The number of blocks follows the count of distinct fingerprints
and changes the cost only, never the pairs found.

Only distinct fingerprints are compared, so exact copies cost nothing, and buckets of two in their
aggregation. Large groups of near
copies would still make all pairs of their bucket, so links are found in rounds: first every
member of a bucket is compared with one pivot, then components are formed, and only buckets that
still hold several components go on; in the last round all pairs across components of a bucket
are compared, inside the join condition. Fingerprints meet their keys once: rounds read the members
of buckets of more than two only. Links within a component are implied by it.

Null doc_ids are ignored as smallest ids unless a component has no other; repeated rows are kept
row by row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import connected_components, durable, lean, text_batches

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: Rounds against a pivot before all pairs across components are compared.
PIVOT_ROUNDS = 2


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: -(SHINGLE_WORDS - 1)].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist())], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the last, the text, and its fingerprint."""
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.columns[-1]), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_fingerprints), "doc_id long, fp long")


def block_masks(n: int) -> list[int]:
    """A mask for each choice of blocks; chosen so that keys and chance pairs cost least for ``n``."""

    def cost(blocks: int) -> float:
        bits = 64 * (blocks - MAX_BITS) / blocks
        return comb(blocks, MAX_BITS) * (n + n * n / 2 / 2**bits)

    blocks = min(range(MAX_BITS + 2, MAX_BITS + 6), key=cost)
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - MAX_BITS)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _bucketed(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    return fps.select("*", F.explode(keys).alias("k")).select(*fps.columns, "k.choice", "k.key")


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def link_components(fps: DataFrame) -> DataFrame:
    """(fp, component) for a frame of distinct fingerprints ``fp``; components are named by a member."""
    fps = fps.select("fp").repartition("fp")
    masks = block_masks(max(fps.count(), 1))
    met = _bucketed(fps, masks).groupBy("choice", "key").agg(F.count(F.lit(1)).alias("many"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    met = durable(met.where("many > 1"), "fingerprint-buckets")
    # Most buckets hold two by chance: these are compared as they are, once.
    two = met.where("many = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).where(_close(F.col("a"), F.col("b")))
    # Only members of larger buckets go on; files of their own tell Spark how few these are.
    large = durable(met.where("many > 2").drop("many"), "fingerprint-buckets")
    members = durable(_bucketed(fps, masks).join(large, ["choice", "key"]), "fingerprint-members")
    rows, edges, labelled = members, two, None
    for step in range(PIVOT_ROUNDS + 1):
        if step:
            rows = members.select("choice", "key", "fp").join(labelled, "fp")
            mixed = rows.groupBy("choice", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.min("component").alias("c0"), F.max("component").alias("c1"))
            rows = rows.join(mixed.where("c0 <> c1").drop("c0", "c1"), ["choice", "key"])
        if step < PIVOT_ROUNDS:
            rows = rows.withColumn("pivot", F.col("high" if step % 2 else "low"))
            found = rows.where((F.col("fp") != F.col("pivot")) & _close(F.col("fp"), F.col("pivot"))).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
        else:
            left = durable(rows.select("choice", "key", "fp", "component"), "fingerprint-members")
            right = left.select("choice", "key", F.col("fp").alias("fp2"), F.col("component").alias("component2"))
            apart = (F.col("component") < F.col("component2")) & _close(F.col("fp"), F.col("fp2"))
            found = left.join(right, ["choice", "key"]).where(apart).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
        edges = edges.unionByName(durable(found.distinct(), "fingerprint-links"))
        tied = connected_components(edges)
        labelled = durable(fps.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")), "fingerprint-labels")
    return labelled.repartition("fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row."""
    marked = durable(fingerprints(docs), "fingerprints")
    smallest = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = link_components(smallest.select("fp"))
    firsts = smallest.join(labels, "fp").groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = labels.join(firsts, "component").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group: of each, one row of the smallest doc_id.

    Null ids come last; among rows of one id, or of null ids only, the first row stays.
    """
    text_batches(docs.sparkSession)
    keyed = durable(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), "keyed-documents")
    slim = keyed.select("key", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    marked = durable(slim.mapInArrow(lean(_fingerprints), "key long, doc_id long, fp long"), "fingerprints")
    firsts = marked.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "key")).alias("first"))
    labels = link_components(firsts.select("fp"))
    stay = firsts.join(labels, "fp").groupBy("component").agg(F.min("first").alias("first")).select("first.key")
    # The rows that go are fewer than those that stay, so that the texts seldom have to move for them.
    gone = durable(marked.select("key").join(stay, "key", "left_anti"), "dropped-documents")
    return keyed.join(gone, "key", "left_anti").select("row.*")
