"""Toxicity: a counterfactually regularised linear classifier over sentences.

Every sentence (cut at ``. ! ?`` and line ends) is the set of its words, a word is
features of itself and its leading characters (those whose share of documents differs between
the classes beyond chance and several-fold), and a sentence's logit is their summed weights.
Sentences inherit their document's label; then each toxic document keeps as positives only the
sentences that the model finds toxic (its best one at least), and the model is fitted again.

Counterfactuals: in every training sentence that names a group of people, the term is swapped
for another of its kind, and the squared change of the logit is penalised, so that naming a
group moves a score as little as the labels allow.

A document's probability comes from its highest sentence logit and its number of sentences by a
logistic fit on documents the sentence model hasn't seen. Null and empty texts have no sentence
and take the bias logit. Training rows: at most ``PER_CLASS`` ids of each class, one row of each,
of at most ``TRAIN_CHARS`` characters; of rows that share their longest sentence's words and
their label only that of the smallest id is used, since copies would make rare words look telling.
Features are counted and sentences encoded on the executors: the driver gets counts and numbers
of the telling features, no texts. Without rows of both classes every score is the share of toxic
labels (0 without labels). Scoring reads whole texts; rows are scored each, so null or repeated
ids and extra columns change nothing, other columns of the name ``toxic_score`` are replaced, and
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import durable, lean, release, text_batches
from quillspark.llm.labelled import held_out, sample

PER_CLASS, TRAIN_CHARS = 2500, 200_000
MIN_DOCS, MIN_Z, MIN_ODDS, ROUNDS, STEPS = 4, 4.0, 4.0, 2, 120
L2, SWAP_PENALTY = 2e-6, 1.0
CACHE_WORDS = 300_000

#: Terms for groups of people, by kind; a term is swapped for the next of its kind.
IDENTITY_TERMS = {
    "religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"],
    "religion_plural": ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"],
    "ethnicity": ["black", "white", "asian", "latino", "african", "european", "arab", "indigenous"],
    "gender": ["woman", "man", "girl", "boy"],
    "gender_plural": ["women", "men", "girls", "boys"],
    "orientation": ["gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender", "queer"],
    "origin": ["immigrant", "native", "refugee", "foreigner"],
    "origin_plural": ["immigrants", "natives", "refugees", "foreigners"],
    "ability": ["disabled", "blind", "deaf", "autistic"],
    "fr": ["femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"],
    "de": ["frauen", "männer", "muslime", "christen", "juden", "einwanderer"],
    "es": ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"],
}
SWAPS = {t: terms[(i + 1) % len(terms)] for terms in IDENTITY_TERMS.values() for i, t in enumerate(terms)}
SENTENCE_END = re.compile(r"[.!?\n\r]+")
WORD = re.compile(r"\w+")


def word_features(raw: str) -> list[int]:
    found = []
    for word in WORD.findall(raw.lower()):
        keys = [word] + [f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n]
        found += [xxhash.xxh64_intdigest(k.encode()) for k in keys]
    return found


def sentences_of(text: str | None) -> list[set[str]]:
    return [words for words in (set(s.split()) for s in SENTENCE_END.split(text or "")) if words]


class _Weights(dict):
    """Words' summed weights, computed once each; emptied when it has grown too large."""

    def __init__(self, weights: dict[int, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, raw: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[raw] = value = sum(self.weights.get(f, 0.0) for f in word_features(raw))
        return value


class Rows:
    """Sentences as rows of feature places: the lengths of the rows, and all places one after the other."""

    def __init__(self, lengths: np.ndarray, index: np.ndarray, width: int) -> None:
        self.n, self.width, self.index = len(lengths), width, index.astype(np.int64)
        self.row = np.repeat(np.arange(self.n), lengths)

    def only(self, used: np.ndarray) -> Rows:
        mine = used[self.row]
        return Rows(np.bincount(self.row[mine], minlength=self.n)[used], self.index[mine], self.width)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.index], minlength=self.n)

    def gradient(self, error: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=error[self.row], minlength=self.width)


def _swapped(words: set[str]) -> set[str] | None:
    """The sentence with every group term swapped for another of its kind; None if it has none."""
    changed = {w: WORD.sub(lambda m: SWAPS.get(m[0].lower(), m[0]), w) for w in words}
    return set(changed.values()) if any(a != b for a, b in changed.items()) else None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit_rows(rows: Rows, labels: np.ndarray, share: np.ndarray, pair: tuple[Rows, Rows] | None) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the mean log loss plus L2 and the penalty on swapped pairs."""
    weights, bias = np.zeros(rows.width), float(np.log((labels @ share + 1e-3) / ((1 - labels) @ share + 1e-3)))
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        error = (_sigmoid(rows.logits(weights) + bias) - labels) * share
        gradient = rows.gradient(error) + L2 * weights
        if pair is not None:
            change = (pair[0].logits(weights) - pair[1].logits(weights)) * (2 * SWAP_PENALTY / pair[0].n)
            gradient += pair[0].gradient(change) - pair[1].gradient(change)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        weights -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        bias -= 0.2 * float(error.sum())
    return weights, bias


def _kind(text: str | None) -> int:
    """A hash of the words of a text's longest sentence, equal for copies."""
    longest = max(sentences_of(text), key=len, default=set())
    return xxhash.xxh64_intdigest("\n".join(sorted(longest)).encode())


def _features(text: str | None) -> np.ndarray:
    words = set().union(*sentences_of(text))
    return np.unique(np.fromiter((f for w in words for f in word_features(w)), dtype=np.uint64))


def _telling(feature: np.ndarray, a: np.ndarray, both: np.ndarray, ones: int, zeros: int) -> dict[int, int]:
    """Places of the features whose share of documents differs between the classes beyond chance.

    ``a`` and ``both``: the toxic and all documents with a feature; ``ones`` and ``zeros``: of either class.
    """
    ones, zeros = max(ones, 1), max(zeros, 1)
    pooled = both / (ones + zeros)
    spread = np.sqrt(np.maximum(pooled * (1 - pooled) * (1 / ones + 1 / zeros), 1e-12))
    telling = (both >= MIN_DOCS) & (np.abs(a / ones - (both - a) / zeros) >= MIN_Z * spread)
    in_ones, in_zeros = (a + 0.5) / (ones + 1), (both - a + 0.5) / (zeros + 1)
    odds = in_ones / (1 - np.minimum(in_ones, 0.999)) / (in_zeros / (1 - np.minimum(in_zeros, 0.999)))
    telling &= (odds >= MIN_ODDS) | (odds <= 1 / MIN_ODDS)
    return {int(f): i for i, f in enumerate(np.sort(feature[telling]))}


def _encoded(text: str | None, places: dict[int, int]) -> tuple[bytes, ...]:
    """Sentences, those that name a group, and these with their terms swapped: lengths and places each."""

    def rows(sentences: list[set[str]]) -> tuple[bytes, bytes]:
        found = [[places[f] for w in sorted(words) for f in word_features(w) if f in places] for words in sentences]
        return np.array([len(r) for r in found], dtype="<i4").tobytes(), np.array([i for r in found for i in r], dtype="<i4").tobytes()

    sentences = sentences_of(text)
    swaps = [(s, other) for s in sentences if (other := _swapped(s)) is not None]
    return *rows(sentences), *rows([a for a, _ in swaps]), *rows([b for _, b in swaps])


def _joined(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype="<i4").astype(np.int64)


def _fit_encoded(docs: list[tuple[bytes, ...]], y: np.ndarray, calibrating: np.ndarray, places: dict[int, int], share: float) -> dict:
    width = len(places)
    learning = [d for d, c in zip(docs, calibrating) if not c]
    rows = Rows(_joined([d[0] for d in docs]), _joined([d[1] for d in docs]), width)
    n_sentences = np.array([len(d[0]) // 4 for d in docs], dtype=np.int64)
    of = np.repeat(np.arange(len(docs)), n_sentences)
    target, seen = y[of], ~calibrating[of]
    before, after = (Rows(_joined([d[k] for d in learning]), _joined([d[k + 1] for d in learning]), width) for k in (2, 4))
    pair = (before, after) if before.n else None
    positive = target == 1
    for _ in range(ROUNDS):
        used = seen & ((target == 0) | positive)
        goal = target[used]
        weight = np.where(goal == 1, 0.5 / max(goal.sum(), 1), 0.5 / max((1 - goal).sum(), 1))
        weights, bias = _fit_rows(rows.only(used), goal, weight, pair)
        logits = rows.logits(weights) + bias
        best = np.full(len(docs), -np.inf)
        np.maximum.at(best, of, logits)
        positive = (target == 1) & ((logits > 0) | (logits == best[of]))
    x = np.column_stack([np.where(n_sentences > 0, best, bias), np.log1p(n_sentences)])
    use = calibrating if 0 < y[calibrating].sum() < calibrating.sum() else ~calibrating
    a, goal, top = np.column_stack([np.ones(int(use.sum())), x[use]]), y[use], np.zeros(3)
    count = np.where(goal == 1, share / max(goal.mean(), 1e-9), (1 - share) / max(1 - goal.mean(), 1e-9))
    for _ in range(30):
        p = _sigmoid(a @ top)
        step = np.linalg.solve(a.T @ (a * (count * p * (1 - p))[:, None]) + 1e-2 * np.eye(3), a.T @ (count * (goal - p)) - 1e-2 * top)
        top += np.clip(step, -2, 2)
    return {"weights": {f: float(weights[i]) for f, i in places.items()}, "bias": bias, "top": top}


def _share_only(share: float) -> dict:
    return {"weights": {}, "bias": 0.0, "top": np.array([np.log((share + 1e-6) / (1 - share + 1e-6)), 0.0, 0.0])}


def fit(texts: list[str], labels: list[int], share: float) -> dict:
    """Model of a few labelled texts at hand: feature weights, bias, and the document-level calibration.

    ``share`` is the share of toxic rows among all labelled rows, of which the sample holds as
    many of either class; the calibration weighs the classes accordingly.
    """
    firsts = {(_kind(t), y): i for i, (t, y) in reversed(list(enumerate(zip(texts, labels))))}
    kept = sorted(firsts.values())
    y = np.array([labels[i] for i in kept], dtype=float)
    if not 0 < share < 1 or not 0 < y.sum() < len(y):
        return _share_only(share)
    calibrating = np.arange(len(kept)) % 4 == 3
    features = [_features(texts[i]) for i, c in zip(kept, calibrating) if not c]
    own = y[~calibrating]
    feature, at = np.unique(np.concatenate(features), return_inverse=True)
    a = np.bincount(at, weights=np.repeat(own, [len(f) for f in features]), minlength=len(feature))
    places = _telling(feature, a, np.bincount(at, minlength=len(feature)), int(own.sum()), int((1 - own).sum()))
    return _fit_encoded([_encoded(texts[i], places) for i in kept], y, calibrating, places, share)


def _summary(logits: list[float], bias: float) -> tuple[float, float]:
    return (max(logits) if logits else 0.0) + bias, float(np.log1p(len(logits)))


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = np.fromiter((_kind(t.as_py()) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds.view(np.int64))], names=["doc_id", "label", "kind"])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2)):
            found = _features(text.as_py()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), label, dtype=np.int32))], names=["feature", "label"])


def train(docs: DataFrame, labels: DataFrame) -> dict:
    spark = docs.sparkSession
    text_batches(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    picked = durable(sample(docs, labels, "toxic", PER_CLASS).where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS), "toxic-sample")
    rows = picked.select("doc_id", F.col("label").cast("int").alias("label"), "text")
    firsts = rows.mapInArrow(_kinds, "doc_id long, label int, kind long").groupBy("kind", "label").agg(F.min("doc_id").alias("doc_id"))
    kept = sorted((r["doc_id"], r["label"]) for r in firsts.select("doc_id", "label").collect())
    y = np.array([label for _, label in kept], dtype=float)
    if not 0 < share < 1 or not 0 < y.sum() < len(y):
        return _share_only(share)
    chosen = spark.createDataFrame([(i, n % 4 == 3) for n, (i, _) in enumerate(kept)], "doc_id long, calibrating boolean")
    used = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text", "calibrating")
    calibrating = np.arange(len(kept)) % 4 == 3
    counts = used.where("not calibrating").mapInArrow(_feature_rows, "feature long, label int").groupBy("feature").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("both")).where(F.col("both") >= MIN_DOCS)
    table = counts.toArrow()
    feature, a, both = (table.column(c).to_numpy() for c in ("feature", "a", "both"))
    own = y[~calibrating]
    places = _telling(feature.view(np.uint64), a.astype(float), both.astype(float), int(own.sum()), int((1 - own).sum()))
    shipped = spark.sparkContext.broadcast(places)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(_encoded(t.as_py(), shipped.value) for t in batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in columns)] if batch.num_rows else [batch.column(0), *[pa.array([], pa.binary())] * 6], names=["doc_id", *"abcdef"])

    found = {r[0]: tuple(r)[1:] for r in used.mapInArrow(encode, "doc_id long, " + ", ".join(f"{c} binary" for c in "abcdef")).collect()}
    release(picked)
    return _fit_encoded([found[i] for i, _ in kept], y, calibrating, places, share)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) and ``toxic_score`` of every row."""
    text_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("toxic_score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        known = _Weights(model["weights"])
        look, top, bias = known.__getitem__, model["top"], model["bias"]
        for batch in batches:
            summaries = [_summary([sum(map(look, words)) for words in sentences_of(t.as_py())], bias) for t in batch.column(at)]
            x = np.array(summaries, dtype=float).reshape(-1, 2)
            found = _sigmoid(top[0] + x @ top[1:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "toxic_score"])

    from pyspark.sql import types as T

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(slim, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= threshold).cast("int").alias("predicted"))
