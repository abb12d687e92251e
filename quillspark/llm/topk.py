"""Exact top-k inner-product search by a three-phase uniform threshold.

Every vector is cut into ``LISTS`` runs of dimensions; each run gives a list of local scores,
and a row's score is the sum of its local scores.

1. Gather: each list names its best rows for a query; only their scores are summed, and the k-th
   best sum is a cutoff that the k-th best score cannot be below.
2. The cutoff goes back with the queries. A row whose score reaches it has some list in which
   its local score reaches cutoff / LISTS (else the sum falls short, negative scores or not),
   so these entries suffice. A list in which the lengths of two runs multiply to less holds
   none, and isn't computed for such rows and queries.
3. The entries' remaining local scores are looked up, or computed for the entries alone; sums that
   reach the cutoff compete.

Rows are packed to blocks where they lie, once, and don't move again. Queries go to them in
rounds: a round's query blocks take at most about ``ROUND_BYTES``, however many queries there
are, and that is broadcast. A task keeps k sums a query of the round, and a pair of blocks gives at
most k rows a query, so neither hot vectors nor ties grow anything.

Vectors are floor(scale * x) of each component, held within 62 bits. Null vectors, and those that
hold a null or non-finite component, take no part, nor do rows with a null id. Only vectors of
equal length meet, empty ones included; rows that bear the query's id are its own and no candidates; repeated rows
all compete. An id with several vectors asks with each of them, and all answers compete. Queries
that have no candidate give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import durable, lean, release

#: Lists of local scores; rows, and numbers, of a block; bytes of a round's query blocks.
LISTS, BLOCK, BLOCK_NUMBERS, ROUND_BYTES = 4, 2048, 1 << 21, 1 << 24
#: Sums whose bound is below these are exact in single and in double precision.
EXACT = ((2.0**23, np.float32), (2.0**52, np.float64))
NONE = np.iinfo(np.int64).min
PACKED = "no long, dim int, ids binary, cutoffs binary, kind string, numbers binary"
FOUND = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]


def _pack(scale: float):
    """(id, vector, cutoff) to blocks of vectors of one length, as the smallest integers that hold them."""

    def block(number: int, dim: int, parts: list) -> pa.RecordBatch:
        ids, cutoffs, numbers = (np.concatenate(p) for p in zip(*parts))
        low, high = numbers.min(initial=0), numbers.max(initial=0)
        kind = next(k for k in ("int8", "int16", "int32", "int64") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        row = [(TaskContext.get().partitionId() << 32) + number, dim, ids.tobytes(), cutoffs.tobytes(), kind, numbers.astype(kind).tobytes()]
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[c.split()[0] for c in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        rows, total, serial = {}, 0, count()
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                sizes = pc.list_value_length(batch.column(1)).to_numpy()
                for dim in np.unique(sizes).tolist():
                    mine = batch.filter(pa.array(sizes == dim))
                    numbers = np.floor(scale * mine.column(1).flatten().to_numpy()).clip(-(2.0**62), 2.0**62).astype(np.int64).reshape(mine.num_rows, dim)
                    ids, cutoffs = mine.column(0).to_numpy(), pc.fill_null(mine.column(2), NONE).to_numpy()
                    most = max(1, min(BLOCK, BLOCK_NUMBERS // max(dim, 1)))
                    for i in range(0, len(ids), most):
                        part = (ids[i : i + most], cutoffs[i : i + most], numbers[i : i + most])
                        n = len(part[0])
                        if rows.get(dim, 0) + n > most:
                            yield block(next(serial), dim, held.pop(dim))
                            total -= rows.pop(dim) * dim
                        held.setdefault(dim, []).append(part)
                        rows[dim] = rows.get(dim, 0) + n
                        total += n * dim
                        if total > 2 * BLOCK_NUMBERS:
                            yield from (block(next(serial), d, p) for d, p in held.items())
                            held, rows, total = {}, {}, 0
        yield from (block(next(serial), d, p) for d, p in held.items())

    return run


def _side(ids: bytes, cutoffs: bytes, kind: str, numbers: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(cutoffs, np.int64), np.frombuffer(numbers, kind).reshape(len(ids), dim)


def _lengths(numbers: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", numbers, numbers, dtype=np.float64))


def _exact(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in the fastest type in which every sum of their products is exact (by their lengths)."""
    top = _lengths(queries).max(initial=0.0) * _lengths(rows).max(initial=0.0) * (1 + 1e-9)
    kind = next((k for bound, k in EXACT if top < bound), np.int64)
    return queries.astype(kind), rows.astype(kind)


def _runs(dim: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), LISTS)


def heads(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The k best sums (or NONE) of each query among the rows that head one of its lists."""
    q, x = _exact(queries, rows)
    local = [q[:, r] @ x[:, r].T for r in _runs(q.shape[1])]
    n = min(k, len(rows))
    seen = []
    for scores in local:
        ranked = np.where(own, -np.inf, scores)
        seen.append(np.argpartition(-ranked, n - 1, axis=1)[:, :n])
    to = np.sort(np.concatenate(seen, axis=1), axis=1)
    at = np.arange(len(q))[:, None]
    sums = sum(scores[at, to].astype(np.int64) for scores in local)
    again = np.concatenate([np.zeros((len(q), 1), dtype=bool), to[:, 1:] == to[:, :-1]], axis=1)
    sums[again | own[at, to]] = NONE
    sums = np.concatenate([sums, np.full((len(q), k), NONE)], axis=1)
    return np.sort(sums, axis=1)[:, ::-1][:, :k]


def entries(queries: np.ndarray, rows: np.ndarray, cutoffs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of every pair that reaches cutoff / LISTS in some list; no other score is summed."""
    q, x = _exact(queries, rows)
    least = cutoffs / LISTS - 1e-9 * np.abs(cutoffs.astype(np.float64))
    lists, enough = [], np.zeros(own.shape, dtype=bool)
    for r in _runs(q.shape[1]):
        ql, xl = _lengths(queries[:, r]), _lengths(rows[:, r])
        # No local score exceeds the product of the two lengths.
        may = np.where(least > 0, ql * (1 + 1e-9) / np.where(least > 0, least, 1.0), np.inf)
        qs = np.flatnonzero(may * xl.max() >= 1 if xl.max() > 0 else least <= 0)
        xs = np.flatnonzero(xl * may.max() >= 1) if np.isfinite(may).all() else np.arange(len(x))
        scores = q[np.ix_(qs, r)] @ x[np.ix_(xs, r)].T
        at, to = np.nonzero(scores >= least[qs, None])
        enough[qs[at], xs[to]] = True
        lists.append((r, qs, xs, scores))
    at, to = np.nonzero(enough & ~own)
    total = np.zeros(len(at), dtype=np.int64)
    for r, qs, xs, scores in lists:
        q_place, x_place = np.full(len(q), -1), np.full(len(x), -1)
        q_place[qs], x_place[xs] = np.arange(len(qs)), np.arange(len(xs))
        i, j = q_place[at], x_place[to]
        there = (i >= 0) & (j >= 0)
        total[there] += scores[i[there], j[there]].astype(np.int64)
        missing = np.flatnonzero(~there)
        for start in range(0, len(missing), 1 << 16):
            some = missing[start : start + (1 << 16)]
            total[some] += np.einsum("ij,ij->i", q[np.ix_(at[some], r)], x[np.ix_(to[some], r)]).astype(np.int64)
    return at, to, total


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            dim, number, *values = (batch.column(c)[i].as_py() for c in range(10))
            yield number, _side(*values[:4], dim), _side(*values[4:], dim)


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FOUND)], names=[n for n, _ in FOUND])


def _gather(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for number, (q_ids, _, queries), (ids, _, rows) in _pairs(batches):
            found = heads(queries, rows, q_ids[:, None] == ids[None, :], k)
            if number in best:
                found = np.sort(np.concatenate([best[number][1], found], axis=1), axis=1)[:, ::-1][:, :k]
            best[number] = (q_ids, found)
        for q_ids, found in best.values():
            at, place = np.nonzero(found > NONE)
            yield _batch(q_ids[at], np.zeros(len(at), dtype=np.int64), found[at, place])

    return run


def _resolve(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (q_ids, cutoffs, queries), (ids, _, rows) in _pairs(batches):
            at, to, score = entries(queries, rows, cutoffs, q_ids[:, None] == ids[None, :])
            ok = score >= cutoffs[at]
            at, to, score = at[ok], to[ok], score[ok]
            order = np.lexsort((ids[to], ~score, at))
            at, to, score = at[order], to[order], score[order]
            first = np.searchsorted(at, at)
            keep = np.arange(len(at)) - first < k
            yield _batch(q_ids[at[keep]], ids[to[keep]], score[keep])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows of each query.

    ``is_query`` is a Column over ``vec_id``; ties go to the smaller id.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    clean = clean.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    queries = clean.where(is_query).dropDuplicates(["vec_id", "v"])
    n, longest = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    rounds = max(1, -(-n * (8 * longest + 16) // ROUND_BYTES))
    pack = lean(_pack(scale))
    spread = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    no_cutoff = F.lit(None).cast("long").alias("cutoff")
    rows = durable(clean.repartition(spread).select("vec_id", "v", no_cutoff).mapInArrow(pack, PACKED), "vectors")
    asked = durable(queries.repartition(rounds).select("vec_id", "v", F.pmod(F.spark_partition_id(), F.lit(rounds)).alias("round")), "queries", partition_by="round")
    columns = ["ids", "cutoffs", "kind", "numbers"]
    schema = "query_id long, vec_id long, score long"

    def meet(packed: DataFrame, phase) -> DataFrame:
        few = packed.select("dim", "no", *(F.col(c).alias(f"q_{c}") for c in columns))
        both = rows.select("dim", *columns).join(F.broadcast(few), "dim").select("dim", "no", *(f"q_{c}" for c in columns), *columns)
        return both.mapInArrow(lean(phase), schema)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    done = []
    for number in range(rounds):
        mine = asked.where(F.col("round") == number).select("vec_id", "v")
        gathered = meet(mine.select("vec_id", "v", no_cutoff).mapInArrow(pack, PACKED), _gather(k))
        cutoffs = gathered.withColumn("place", place).where(F.col("place") == k).select(F.col("query_id").alias("of"), F.col("score").alias("cutoff"))
        told = durable(mine.join(cutoffs, F.col("vec_id") == F.col("of"), "left").select("vec_id", "v", "cutoff").mapInArrow(pack, PACKED), "cutoffs")
        found = meet(told, _resolve(k)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        done.append(durable(found.select("query_id", "vec_id", "score"), "best"))
        release(told)
    release(rows)
    release(asked)
    found = reduce(DataFrame.unionAll, done)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
