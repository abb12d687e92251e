"""Suffix-array dedup: a logarithmic family of sparse suffix arrays over UTF-8 bytes.

A byte is removed if a ``WINDOW``-byte string that covers it starts anywhere else too, in the
same text or another; matches never cross documents and are judged on the input.

Sampling: of every window the leftmost ``GRAM``-byte string with the least hash is its anchor, so
equal windows have equal anchors at equal places, and a suffix array of anchors (one suffix in
about 170) sees every long match. A suffix is keyed by its leading bytes and a hash of its first
``GRAM`` bytes; with it goes a hash of everything that the anchor's own windows cover.

Index family: each batch of chunks gets a suffix array: its entries in the order of their keys over
all partitions, equal ones counted. It is merged with every existing level in key order, and where
neighbours of the merged order have one key, that key occurs again. Then it becomes a level, and
levels of equal rank merge into one of the next rank, so n batches make log2(n) levels. Levels,
matches and texts lie in the index's folder: a later :class:`SuffixIndex` over the same folder goes
on from there, with further batches of documents.

Resolution, for keys that occur again: anchors whose whole cover occurs twice are duplicates in
all their windows. Where covers differ, the windows of one anchor of each cover are compared by
64-bit hash in buckets drawn from a second hash; every chunk settles its own repeats and sends
each distinct hash once, so a passage that all documents share costs one hash a chunk. The number
of buckets follows the number of windows, so that a bucket fits a task. Texts lie and travel in
one compressed row a chunk.

Null texts count as empty; null and repeated doc_ids are kept row by row (rows are known by chunk
and place); texts under ``WINDOW`` bytes lose nothing; extra columns are ignored; an empty table
gives no rows. Two different windows are taken for equal only if 64 bits and the bucket of two
hashes agree.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import durable, listed, new_path, release, text_batches

WINDOW, GRAM = 400, 64
#: Bytes of text in a chunk, bytes hashed at a time, windows of a bucket, batches of the index.
CHUNK_BYTES, PIECE_BYTES, BUCKET_WINDOWS, BATCHES = 8_000_000, 1 << 20, 1_000_000, 4
_PLACE = np.uint64((1 << 22) - 1)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _packed(**columns: pa.Array | np.ndarray) -> bytes:
    """Columns of equal length as one compressed Arrow stream."""
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()})
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue()


def _unpacked(packed: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed).read_next_batch()


def _numbers(packed: bytes, name: str) -> np.ndarray:
    return _unpacked(packed).column(name).to_numpy(zero_copy_only=False)


def _texts(packed: bytes) -> tuple[list, list[bytes]]:
    batch = _unpacked(packed)
    return batch.column("id").to_pylist(), batch.column("text").to_pylist()


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    x = a * _C1
    x += b
    x ^= x >> np.uint64(29)
    x *= _C2
    x ^= x >> np.uint64(32)
    return x


def _hashes(buffer: bytes, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of the strings of each size (powers of two from 8) at every place of ``buffer``."""
    n = len(buffer)
    eight = np.empty(max(n - 7, 0), dtype=np.uint64)
    for shift in range(min(8, n - 7)):
        eight[shift::8] = np.frombuffer(buffer, dtype="<u8", offset=shift, count=(n - shift) // 8)
    out, size, h = {}, 8, _mix(eight, np.uint64(7))
    while True:
        if size in sizes:
            out[size] = h
        if size >= max(sizes):
            return out
        h = _mix(h[:-size], h[size:])
        size *= 2


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values: of a block's end and the next block's start."""
    n = len(x)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = x
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for each i in turn."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _pieces(spans: Iterator[tuple[object, bytes, int, int]]) -> Iterator[tuple[bytes, list]]:
    """Buffers of about ``PIECE_BYTES`` from (tag, text, first window, windows); long spans are cut."""
    parts, tags, size = [], [], 0
    for tag, text, first, count in spans:
        while count > 0:
            n = min(count, PIECE_BYTES)
            parts.append(text[first : first + n + WINDOW - 1])
            tags.append((tag, first, n))
            size += len(parts[-1])
            first, count = first + n, count - n
            if size >= PIECE_BYTES:
                yield b"".join(parts), tags
                parts, tags, size = [], [], 0
    if parts:
        yield b"".join(parts), tags


def anchors_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text's place, first window, windows, key, cover) of the anchors of some texts, in arrays."""
    for buffer, tags in _pieces((i, t, 0, len(t) - WINDOW + 1) for i, t in enumerate(texts)):
        gram = _hashes(buffer, (GRAM,))[GRAM]
        least = _window_min((gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64), WINDOW - GRAM + 1)
        counts = np.array([n for _, _, n in tags])
        bases = np.cumsum(counts + WINDOW - 1) - (counts + WINDOW - 1)
        windows, piece = _spread(bases, counts), np.repeat(np.arange(len(tags)), counts)
        place = (least[windows] & _PLACE).astype(np.int64)
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])
        at = np.nonzero(new)[0]
        size = np.diff(np.append(at, len(place)))
        anchor, first, piece = place[at], windows[at], piece[at]
        raw = np.frombuffer(buffer, dtype=np.uint8).astype(np.uint64)
        lead = (raw[anchor] << np.uint64(16)) | (raw[anchor + 1] << np.uint64(8)) | raw[anchor + 2]
        key = ((lead << np.uint64(40)) | (gram[anchor] >> np.uint64(24))).view(np.int64)
        digest = xxhash.xxh3_64_intdigest
        cover = np.fromiter((digest(buffer[a : a + n + WINDOW - 1], seed) for a, n, seed in zip(first.tolist(), size.tolist(), (anchor - first).tolist())), dtype=np.uint64, count=len(first))
        texts_at, offset = np.array([t for t, _, _ in tags]), np.array([f for _, f, _ in tags])
        yield texts_at[piece], first - bases[piece] + offset[piece], size, key, cover.view(np.int64)


_SAMPLED = "kind string, chunk long, place long, windows int, key long, cover long, payload binary"


def _sample(batch_no: int):
    def rows(chunk: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        packed = _packed(id=pa.array(ids, pa.int64()), text=pa.array(texts, pa.large_binary()))
        one = {"kind": ["texts"], "chunk": [chunk], "place": [None], "windows": [None], "key": [None], "cover": [None], "payload": [packed]}
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one.values(), types)], names=list(one))
        for text, first, size, key, cover in anchors_of(texts):
            n = len(key)
            columns = [pa.array(["anchors"] * n), pa.array(np.full(n, chunk)), pa.array((text << 32) | first), pa.array(size.astype(np.int32)), pa.array(key), pa.array(cover), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=list(one))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, texts, size = (batch_no << 44) | (TaskContext.get().partitionId() << 20), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append((text.as_py() or "").encode())
                size += len(texts[-1]) + 64
                if size >= CHUNK_BYTES:
                    yield from rows(chunk, ids, texts)
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if ids:
            yield from rows(chunk, ids, texts)

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in key order those keys that their neighbour has too, or that are counted more than once; once each."""
    last, told = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        before = np.empty(len(key), dtype=bool)
        before[1:] = key[1:] == key[:-1]
        before[0] = last is not None and key[0] == last
        starts = np.nonzero(~before)[0] if not before[0] else np.concatenate([[0], np.nonzero(~before)[0]])
        again = np.add.reduceat(np.where(before, 2, n), starts) > 1
        found = key[starts][again]
        if before[0] and told:
            found = found[1:]
        told = bool(again[-1]) or (len(starts) == 1 and bool(before[0]) and told)
        last = key[-1]
        yield pa.RecordBatch.from_arrays([pa.array(found)], names=["key"])


class SuffixIndex:
    """Levels of suffix arrays in a folder; a level of rank r holds 2**r batches.

    Numbered states list the files that count. A call's files are all written before its state is, and
    what that state leaves out is deleted only afterwards, so a call that fails at any write leaves the
    index as it was before.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or new_path(spark, "suffix-index")
        self._open()

    def _open(self) -> None:
        """The last state that was written whole."""
        self.number = max((int(p.split("/")[-2]) for p in listed(self.spark, f"{self.path}/states/*/_SUCCESS")), default=0)
        rows = self.spark.read.schema("kind string, rank int, path string").json(f"{self.path}/states/{self.number:08d}").collect() if self.number else []
        self.levels = sorted(((r["rank"], r["path"]) for r in rows if r["kind"] == "level"), reverse=True)
        self.found = [r["path"] for r in rows if r["kind"] == "matches"]
        self.samples = [r["path"] for r in rows if r["kind"] == "samples"]
        self.published, self.stale = {p for _, p in self.levels}, []

    def _kept(self, df: DataFrame, name: str) -> str:
        return durable(df, name, folder=self.path)._quill_path

    def _note(self) -> None:
        """Write the next state, then delete what only the ones before it name."""
        rows = [("level", r, p) for r, p in self.levels] + [("matches", 0, p) for p in self.found] + [("samples", 0, p) for p in self.samples]
        self.spark.createDataFrame(rows, "kind string, rank int, path string").coalesce(1).write.json(f"{self.path}/states/{self.number + 1:08d}")
        for old in self.stale:
            release(old, self.spark)
        if self.number:
            release(f"{self.path}/states/{self.number:08d}", self.spark)
        self.number, self.published, self.stale = self.number + 1, {p for _, p in self.levels}, []

    def _array(self, entries: DataFrame) -> str:
        grouped = entries.groupBy("key", "cover").agg(F.sum("n").alias("n"), F.first("chunk").alias("chunk"), F.first("place").alias("place"), F.first("windows").alias("windows"))
        return self._kept(grouped.repartitionByRange("key").sortWithinPartitions("key", "cover"), "suffix-array")

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*paths)

    def add(self, docs: DataFrame, batches: int = 1) -> None:
        """Take documents in, as so many batches, all of them or, if anything fails, none."""
        try:
            self._add(docs, batches)
        except BaseException:
            self._open()
            raise

    def _add(self, docs: DataFrame, batches: int) -> None:
        text_batches(self.spark)
        slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        path = durable(slim.mapInArrow(_sample(len(self.samples)), _SAMPLED), "suffix-samples", "kind", folder=self.path)._quill_path
        anchors = self.spark.read.schema(_SAMPLED).parquet(path).where("kind = 'anchors'").select("chunk", "place", "windows", "key", "cover", F.lit(1).cast("long").alias("n"))
        for b in range(batches):
            self._take(anchors.where(F.pmod(F.xxhash64("chunk"), F.lit(batches)) == b))
        self.samples.append(path)
        self._note()

    def _take(self, anchors: DataFrame) -> None:
        new, rank = self._array(anchors), 0
        for other in [[], *([p] for _, p in self.levels)]:
            merged = self._read([new, *other]).select("key", "n").repartitionByRange("key").sortWithinPartitions("key")
            self.found.append(self._kept(merged.mapInArrow(_neighbours, "key long"), "suffix-matches"))
        while self.levels and self.levels[-1][0] == rank:
            _, level = self.levels.pop()
            merged, rank = self._array(self._read([level, new])), rank + 1
            for old in (level, new):
                if old in self.published:
                    self.stale.append(old)
                else:
                    release(old, self.spark)
            new = merged
        self.levels.append((rank, new))

    def repeated(self) -> DataFrame:
        """Entries (key, cover, n, chunk, place, windows) of all levels whose key occurs again."""
        whole = self._read([p for _, p in self.levels])
        if len(self.levels) > 1:
            whole = whole.groupBy("key", "cover").agg(F.sum("n").alias("n"), F.first("chunk").alias("chunk"), F.first("place").alias("place"), F.first("windows").alias("windows"))
        return whole.join(self._read(self.found).distinct(), "key", "left_semi")


def _compare(n_buckets: int):
    """A chunk's disputed windows to rows: repeats inside the chunk, and distinct hashes by bucket."""

    def run(texts: pa.Table, disputed: pa.Table) -> pa.Table:
        out = []
        if texts.num_rows and disputed.num_rows:
            chunk = texts.column("chunk")[0].as_py()
            _, bodies = _texts(texts.column("payload")[0].as_py())
            place, windows = _disputed(disputed)
            spans = ((None, bodies[p >> 32], p & 0xFFFFFFFF, n) for p, n in zip(place.tolist(), windows.tolist()))
            firsts, seconds = [], []
            for buffer, tags in _pieces(spans):
                h = _hashes(buffer, (16, 128, 256))
                counts = np.array([n for _, _, n in tags])
                at = _spread(np.cumsum(counts + WINDOW - 1) - (counts + WINDOW - 1), counts)
                firsts.append(_mix(_mix(h[256][at], h[128][at + 256]), h[16][at + 384]))
                seconds.append(_mix(h[256][at + WINDOW - 256], h[256][at]) >> np.uint64(20))
            first, second = np.concatenate(firsts), np.concatenate(seconds)
            _, index, inverse, counts = np.unique(first, return_index=True, return_inverse=True, return_counts=True)
            out.append(("repeats", chunk, -1, _packed(at=np.nonzero(counts[inverse] > 1)[0].astype(np.uint32))))
            bucket = (second[index] % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((index, bucket))
            ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            for b in np.unique(bucket).tolist():
                mine = index[order[ends[b] : ends[b + 1]]]
                out.append(("hashes", chunk, b, _packed(hash=first[mine], step=np.diff(mine.astype(np.uint32), prepend=np.uint32(0)))))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["kind", "chunk", "bucket", "payload"])

    return run


def _disputed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    place, windows = table.column("place").to_numpy(), table.column("windows").to_numpy().astype(np.int64)
    order = np.argsort(place, kind="stable")
    return place[order], windows[order]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash rows sorted by bucket to the windows whose hash occurs in several chunks."""

    def settle(rows: list) -> pa.RecordBatch:
        hashes = [_numbers(p, "hash") for _, p in rows]
        _, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        again, out, start = counts[inverse] > 1, [], 0
        for (chunk, payload), own in zip(rows, hashes):
            mask = again[start : start + len(own)]
            start += len(own)
            if mask.any():
                at = np.cumsum(_numbers(payload, "step"), dtype=np.uint32)
                out.append((chunk, _packed(at=at[mask])))
        return pa.RecordBatch.from_arrays([pa.array(["repeats"] * len(out), pa.string()), pa.array([c for c, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], names=["kind", "chunk", "payload"])

    bucket, rows = None, []
    for batch in batches:
        for b, chunk, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if b != bucket and rows:
                yield settle(rows)
                rows = []
            bucket = b
            rows.append((chunk, payload))
    if rows:
        yield settle(rows)


def _cut(texts: pa.Table, marks: pa.Table) -> pa.Table:
    """A chunk's texts and marks to (doc_id, text bytes, n_removed, n_spans, kept bytes)."""
    ids, bodies = _texts(texts.column("payload")[0].as_py()) if texts.num_rows else ([], [])
    kind = np.array(marks.column("kind").to_pylist(), dtype=object)
    spans = [np.zeros((0, 3), dtype=np.int64)]
    place, windows = _disputed(marks.filter(pa.array(kind == "disputed")))
    sure, long = _disputed(marks.filter(pa.array(kind == "sure")))
    spans.append(np.stack([sure >> 32, sure & 0xFFFFFFFF, (sure & 0xFFFFFFFF) + long - 1 + WINDOW], axis=1))
    hits = [_numbers(p, "at") for p in marks.filter(pa.array(kind == "repeats")).column("payload").to_pylist()]
    if hits:
        at = _spread(place, windows)[np.unique(np.concatenate(hits).astype(np.int64))]
        spans.append(np.stack([at >> 32, at & 0xFFFFFFFF, (at & 0xFFFFFFFF) + WINDOW], axis=1))
    spans = np.concatenate(spans)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.searchsorted(spans[:, 0], np.arange(len(bodies) + 1))
    rows = []
    for i, (doc_id, body) in enumerate(zip(ids, bodies)):
        own = spans[ends[i] : ends[i + 1]]
        if not len(own):
            rows.append((doc_id, len(body), 0, 0, body))
            continue
        edge = np.bincount(own[:, 1], minlength=len(body) + 1).astype(np.int64) - np.bincount(own[:, 2], minlength=len(body) + 1)
        gone = np.cumsum(edge[: len(body)]) > 0
        begins = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        rows.append((doc_id, len(body), int(gone.sum()), begins, np.frombuffer(body, dtype=np.uint8)[~gone].tobytes()))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _sure(anchors: DataFrame, twice: DataFrame) -> DataFrame:
    """Anchors whose (key, cover) is in ``twice``, whose pairs are distinct.

    Pairs with over a quarter of a partition's mean share of anchors go by broadcast, so that no
    passage fills a task; they are fewer than four times the partitions, whatever the input.
    """
    spark = anchors.sparkSession
    pairs = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = (twice.agg(F.sum("n")).first()[0] or 0) // pairs
    hot, rest = twice.where(F.col("n") > share).select("key", "cover"), twice.where(F.col("n") <= share).select("key", "cover")
    by, found = ["key", "cover"], ["chunk", "place", "windows"]
    often = anchors.join(F.broadcast(hot), by, "left_semi").select(*found)
    return often.unionAll(anchors.join(F.broadcast(hot), by, "left_anti").join(rest, by, "left_semi").select(*found))


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row."""
    index = SuffixIndex(docs.sparkSession)
    index.add(docs, batches)
    return without_repeats(index, keep=False)


def without_repeats(index: SuffixIndex, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept of every document that the index took in.

    Unless it is kept for further batches, the index's levels, matches and anchors are deleted once read.
    """
    spark = index.spark
    sampled = reduce(DataFrame.unionByName, (spark.read.schema(_SAMPLED).parquet(path) for path in index.samples))
    texts = sampled.where("kind = 'texts'").select("chunk", "payload")
    anchors = sampled.where("kind = 'anchors'").select("chunk", "place", "windows", "key", "cover")
    repeated = durable(index.repeated(), "suffix-repeated")
    if not keep:
        for path in [*(p for _, p in index.levels), *index.found]:
            release(path, spark)
    several = repeated.groupBy("key").agg(F.count(F.lit(1)).alias("covers")).where("covers > 1").select("key")
    disputed = durable(repeated.join(several, "key", "left_semi").select("chunk", "place", "windows"), "suffix-disputed")
    sure = durable(_sure(anchors, repeated.where("n > 1")), "suffix-sure")
    release(repeated)
    if not keep:
        for path in index.samples:
            release(f"{path}/kind=anchors", spark)
    n_windows = disputed.agg(F.sum("windows")).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_windows // BUCKET_WINDOWS))
    compared = texts.groupBy("chunk").cogroup(disputed.groupBy("chunk")).applyInArrow(_compare(n_buckets), "kind string, chunk long, bucket long, payload binary")
    compared = durable(compared, "suffix-windows", "kind")
    hashes = compared.where("kind = 'hashes'").select("bucket", "chunk", "payload")
    met = durable(hashes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "kind string, chunk long, payload binary"), "suffix-met")
    release(f"{compared._quill_path}/kind=hashes", spark)
    own = compared.where("kind = 'repeats'").select("kind", "chunk", "payload")
    blank = F.lit(None)
    marks = (
        met.unionByName(own).select("kind", F.col("chunk").alias("of"), blank.cast("long").alias("place"), blank.cast("int").alias("windows"), "payload")
        .unionByName(disputed.select(F.lit("disputed").alias("kind"), F.col("chunk").alias("of"), "place", "windows", blank.cast("binary").alias("payload")))
        .unionByName(sure.select(F.lit("sure").alias("kind"), F.col("chunk").alias("of"), "place", "windows", blank.cast("binary").alias("payload")))
    )
    return texts.groupBy("chunk").cogroup(marks.groupBy("of")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
