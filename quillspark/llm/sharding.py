"""Sharding along a Hilbert curve over document metadata.

Source, language, size and id are quantised by rank to a few bits each, just enough for the number
of shards (more would fray the shards' boxes): quantiles cut
their values in order (strings by what follows their common prefix), so a level is a range of
values. The Hilbert index of the four levels orders the documents, and runs of that order become
the shards, so that a shard's file covers a compact box in all four dimensions and its min/max
statistics prune it. Law: ``rows`` (shard counts at most one apart).

The exact rank comes without a global sort: cells of the curve are counted and summed up (at
most 16 times the number of shards, or 256), each cell is dealt into as many hashed sub-cells as keep a
sub-cell near ``SUBCELL_ROWS`` rows even if one cell holds everything, and only sub-cells are
sorted. Rows are known by a key of their own, so repeated and null ids are placed each. Null
texts have no bytes and crc 0; null ids, sources and languages have the lowest level; extra
columns are ignored, or written with the rest, whatever their names (only ``shard`` is taken by
the folders); no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import durable

SUBCELL_ROWS = 4096
#: Bytes counted for a document besides its text.
OVERHEAD_BYTES = 8


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index along the Hilbert curve of points with unsigned coordinates below ``2**bits``.

    Gray-code construction: undo the excess rotations from the highest bit down, Gray-encode
    the axes, then interleave their bits.
    """
    x = [a.astype(np.uint64) for a in axes]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(len(x)):
            turned = (x[i] & q) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        flip = np.where((x[-1] & q) != 0, flip ^ (q - one), flip)
    x = [a ^ flip for a in x]
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for a in x:
            out = (out << one) | ((a >> np.uint64(level)) & one)
    return out.astype(np.int64)


def _curve(axes: list[Column], bits: int) -> Column:
    @F.pandas_udf(T.LongType())
    def index(source: pd.Series, lang: pd.Series, size: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([c.to_numpy() for c in (source, lang, size, place)], bits))

    return index(*axes)


def _lead(value: Column, skip: int) -> Column:
    """Seven bytes of a string after its first ``skip``, as a number in the strings' order."""
    return F.conv(F.rpad(F.hex(F.substring(value.cast("binary"), skip + 1, 7)), 14, "0"), 16, 10).cast("long")


def _common(low: str | None, high: str | None) -> int:
    """Bytes that all strings between the least and the greatest begin with."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _levels(base: DataFrame, columns: list[str], bits: int) -> list[Column]:
    """Each column's level by rank: how many of its quantiles a value reaches."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    cuts = base.agg(*(F.percentile_approx(c, shares, 1000).alias(c) for c in columns)).first()
    return [sum((F.when(F.col(c) >= cut, 1).otherwise(0) for cut in cuts[c] or []), F.lit(0)).cast("long") for c in columns]


def _placed(docs: DataFrame, n_shards: int) -> tuple[DataFrame, int]:
    """(key, doc_id, size, text_crc32, cell, rank) of every row of (key, doc_id, text, source, lang), and their number."""
    text = F.coalesce("text", F.lit(""))
    strings = {c: docs.agg(F.min(c), F.max(c)).first() for c in ("source", "lang")}
    measured = docs.select("key", "doc_id", (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *(_lead(F.col(c), _common(*ends)).alias(c) for c, ends in strings.items()))
    base = durable(measured, "shard-sizes")
    n = base.count()
    bits = max(2, -(-(n_shards - 1).bit_length() // 4))
    axes = _levels(base, ["source", "lang", "size", "doc_id"], bits)
    cells = base.select("key", "doc_id", "size", "text_crc32", _curve(axes, bits).alias("cell"))
    n_sub = max(1, -(-n // SUBCELL_ROWS) // 4)
    cells = durable(cells.withColumn("sub", F.pmod(F.xxhash64("doc_id", "text_crc32", "key"), F.lit(n_sub))), "shard-cells")
    counts = cells.groupBy("cell", "sub").agg(F.count(F.lit(1)).alias("k"))
    before = lambda w: F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.groupBy("cell").agg(F.sum("k").alias("k")).select("cell", before(Window.orderBy("cell")).alias("cell_start"))
    subs = counts.select("cell", "sub", before(Window.partitionBy("cell").orderBy("sub")).alias("sub_start"))
    ranked = cells.withColumn("at", F.row_number().over(Window.partitionBy("cell", "sub").orderBy("doc_id", "text_crc32", "size", "key")) - 1)
    rank = F.col("cell_start") + F.col("sub_start") + F.col("at")
    return ranked.join(subs, ["cell", "sub"]).join(starts, "cell").select("key", "doc_id", "size", "text_crc32", "cell", rank.alias("rank")), n


def _dealt(placed: DataFrame, n: int, n_shards: int) -> DataFrame:
    """Runs of the order: shard and slot of each rank."""
    dealt = placed.withColumn("shard", F.expr(f"cast((rank * {n_shards}) div {max(n, 1)} as int)"))
    first = F.expr(f"(cast(shard as long) * {max(n, 1)} + {n_shards - 1}) div {n_shards}")
    return dealt.select("key", "doc_id", "size", "text_crc32", "cell", "shard", (F.col("rank") - first).alias("slot"))


def shard(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, cell, shard and slot of every row of documents."""
    slim = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))
    placed, n = _placed(slim, n_shards)
    return _dealt(placed, n, n_shards).drop("key")


def write_shards(docs: DataFrame, path: str, n_shards: int = 24) -> None:
    """Write documents into one folder a shard; files hold runs of slots, in order."""
    keyed = durable(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), "keyed-documents")
    placed, n = _placed(keyed.select("key", F.col("row.doc_id").cast("long").alias("doc_id"), *(F.col(f"row.{c}").cast("string").alias(c) for c in ("text", "source", "lang"))), n_shards)
    out = keyed.join(_dealt(placed, n, n_shards).select("key", "shard", "slot"), "key")
    runs = out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    runs.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "shard"), "shard").write.partitionBy("shard").parquet(path)
