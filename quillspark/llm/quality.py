"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words and runs of punctuation are tokens, hashed to ``WORDS`` word slots; a word in capitals
puts a marker before itself. Every slot has a fixed sparse ternary index vector; a slot's context
vector is the sum of its neighbours' index vectors within ``REACH`` places, over all of the
corpus, scaled to unit length. Tasks sum their share and Spark adds the sums, so the table that
is broadcast is ``WORDS`` x ``DIM`` numbers whatever the input.

A document is pooled as mean and spread of its context vectors, length of its mean index vector,
mean product of adjacent index vectors (repetition) and log counts. The network (one hidden layer, numpy)
learns from at most ``PER_CLASS`` labelled rows of either class, weighted to the labels' class
shares; a temperature fitted on a quarter of them that it hasn't seen calibrates its
probabilities. Without rows of both classes every score is the share of label 1.

Null and empty texts pool to zeros and are scored like any other. Rows are scored each, so null
or repeated ids and extra columns change nothing (one named ``quality_score`` is replaced); an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import text_batches
from quillspark.llm.labelled import held_out, sample

WORDS, DIM, NONZERO, REACH, SEED = 8192, 32, 4, 2, 20240607
PER_CLASS, HIDDEN, EPOCHS = 3000, 24, 400
CACHE_WORDS, BLOCK = 300_000, 1 << 18
TOKEN = re.compile(r"\w+|[^\w\s]+")
N_FEATURES = 2 * DIM + 5


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zeros of every slot's index vector; slot 0 has none."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((WORDS, DIM)), axis=1)[:, :NONZERO]
    signs = rng.choice(np.array([-1, 1]), size=(WORDS, NONZERO))
    signs[0] = 0
    return places, signs


def _slot(token: str) -> int:
    return 1 + zlib.crc32(token.encode()) % (WORDS - 1)


class Slots(dict):
    """White-space words to their tokens' slots, computed once each."""

    def __missing__(self, raw: str) -> tuple[int, ...]:
        if len(self) > CACHE_WORDS:
            self.clear()
        found: list[int] = []
        for token in TOKEN.findall(raw):
            if len(token) > 1 and token.isupper():
                found.append(_slot("<capitals>"))
            found.append(_slot(token.lower()))
        self[raw] = out = tuple(found)
        return out


def slots_of(text: str | None, known: Slots) -> np.ndarray:
    return np.array([i for w in (text or "").split() for i in known[w]], dtype=np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors by slot, over all texts of a task."""
    places, signs = index_vectors()
    total, known = np.zeros(WORDS * DIM), Slots()
    gap = np.zeros(REACH, dtype=np.int64)

    def add(parts: list[np.ndarray]) -> None:
        ids = np.concatenate(parts)
        for apart in range(1, REACH + 1):
            for word, near in ((ids[:-apart], ids[apart:]), (ids[apart:], ids[:-apart])):
                used = (word > 0) & (near > 0)
                word, near = word[used], near[used]
                for k in range(NONZERO):
                    np.add(total, np.bincount(word * DIM + places[near, k], weights=signs[near, k], minlength=WORDS * DIM), out=total)

    parts, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            parts += [slots_of(text.as_py(), known), gap]
            size += len(parts[-2]) + REACH
            if size >= BLOCK:
                add(parts)
                parts, size = [], 0
    if parts:
        add(parts)
    table = total.reshape(WORDS, DIM).astype(np.int64)
    some = np.nonzero(table.any(axis=1))[0]
    yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(table[some, d]) for d in range(DIM))], names=["slot", *(f"c{d}" for d in range(DIM))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The context vectors (``WORDS`` x ``DIM``, unit length or zero) over all of ``docs``."""
    text_batches(docs.sparkSession)
    columns = [f"c{d}" for d in range(DIM)]
    sums = docs.select("text").mapInArrow(_contexts, "slot long, " + ", ".join(f"{c} long" for c in columns))
    rows = sums.groupBy("slot").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    table = np.zeros((WORDS, DIM))
    table[rows["slot"].to_numpy(dtype=np.int64)] = rows[columns].to_numpy(dtype=float)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(length == 0, 1, length)).astype(np.float32)


class Pooling:
    def __init__(self, vectors: np.ndarray) -> None:
        places, signs = index_vectors()
        self.vectors, self.squares, self.known = vectors, vectors**2, Slots()
        self.index = np.zeros((WORDS, DIM), dtype=np.float32)
        np.put_along_axis(self.index, places, signs.astype(np.float32) / NONZERO**0.5, axis=1)

    def __call__(self, text: str | None) -> np.ndarray:
        ids = slots_of(text, self.known)
        n = len(ids)
        if not n:
            return np.zeros(N_FEATURES, dtype=np.float32)
        slots, counts = np.unique(ids, return_counts=True)
        share = (counts / n).astype(np.float32)
        mean = share @ self.vectors[slots]
        spread = np.sqrt(np.maximum(share @ self.squares[slots] - mean**2, 0))
        same = 0.0
        for at in range(0, n - 1, BLOCK):
            block = ids[at : at + BLOCK + 1]
            same += float(np.einsum("ij,ij->", self.index[block[:-1]], self.index[block[1:]]))
        rest = [np.linalg.norm(share @ self.index[slots]), same / max(n - 1, 1), np.log1p(n), len(slots) / n, np.log1p(len(text or "")) - np.log1p(n)]
        return np.concatenate([mean, spread, np.array(rest)]).astype(np.float32)


def _forward(model: dict, x: np.ndarray) -> np.ndarray:
    """Logits of pooled rows."""
    hidden = np.tanh(((x - model["mean"]) / model["scale"]) @ model["w1"] + model["b1"])
    return hidden @ model["w2"] + model["b2"]


def fit_network(x: np.ndarray, labels: np.ndarray, share: float) -> dict:
    """Two-layer network and its temperature; ``share`` is the share of label 1 among all labels."""
    y = labels.astype(float)
    rng = np.random.default_rng(SEED)
    model = {"mean": x.mean(axis=0) if len(x) else np.zeros(N_FEATURES), "scale": (x.std(axis=0) if len(x) else np.zeros(N_FEATURES)) + 1e-4}
    model |= {"w1": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": 0.0, "temperature": 1.0}
    if not 0 < share < 1 or not 0 < y.sum() < len(y):
        return model | {"w2": np.zeros(HIDDEN), "b2": float(np.log((share + 1e-6) / (1 - share + 1e-6)))}
    late = np.arange(len(y)) % 4 == 3
    if not 0 < y[late].sum() < late.sum():
        late = np.zeros(len(y), dtype=bool)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    a, goal, w = ((x - model["mean"]) / model["scale"])[~late], y[~late], weight[~late] / weight[~late].sum()
    names = ("w1", "b1", "w2", "b2")
    moments = {k: (np.zeros_like(np.asarray(model[k])), np.zeros_like(np.asarray(model[k]))) for k in names}
    for step in range(1, EPOCHS + 1):
        hidden = np.tanh(a @ model["w1"] + model["b1"])
        error = (1 / (1 + np.exp(-np.clip(hidden @ model["w2"] + model["b2"], -40, 40))) - goal) * w
        back = np.outer(error, model["w2"]) * (1 - hidden**2)
        gradients = {"w1": a.T @ back + 1e-4 * model["w1"], "b1": back.sum(axis=0), "w2": hidden.T @ error + 1e-4 * model["w2"], "b2": error.sum()}
        for k in names:
            m, v = moments[k]
            m, v = 0.9 * m + 0.1 * gradients[k], 0.99 * v + 0.01 * gradients[k] ** 2
            moments[k] = (m, v)
            model[k] = model[k] - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    judged = late if late.any() else ~late
    logits, goal, w = _forward(model, x[judged]), y[judged], weight[judged]

    def loss(temperature: float) -> float:
        z = np.clip(logits / temperature, -40, 40)
        return float((w * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * goal)).sum())

    model["temperature"] = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def _pooled(shipped, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pooling(shipped.value)
        for batch in batches:
            pooled = [pool(t.as_py()).tobytes() for t in batch.column(at)]
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(pooled, pa.binary())], names=[*names, "pooled"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict]:
    """(word vectors over all documents, network fitted on the labelled sample)."""
    vectors = word_vectors(docs)
    shipped = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = sample(docs, labels, "quality", PER_CLASS).select("doc_id", "label", "text")
    found = sorted(tuple(r) for r in rows.mapInArrow(_pooled(shipped, 2), "doc_id long, label int, pooled binary").collect())
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg(F.col("quality").cast("double"))).first()[0] or 0.0
    x = np.stack([np.frombuffer(p, dtype=np.float32) for _, _, p in found]).astype(float) if found else np.zeros((0, N_FEATURES))
    return vectors, fit_network(x, np.array([y for _, y, _ in found]), share)


def score(docs: DataFrame, vectors: np.ndarray, model: dict) -> DataFrame:
    """All columns of ``docs`` and ``quality_score`` of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast((vectors, model))
    docs = docs.drop("quality_score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, model = shipped.value
        pool = Pooling(vectors)
        for batch in batches:
            x = np.array([pool(t.as_py()) for t in batch.column(at)], dtype=float).reshape(-1, N_FEATURES)
            found = 1 / (1 + np.exp(-np.clip(_forward(model, x) / model["temperature"], -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "quality_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(slim, *train(slim, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
