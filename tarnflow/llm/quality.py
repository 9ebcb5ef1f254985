"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of a row for the word and of rows for its character
n-grams, found by hash in one table of ``BUCKETS`` rows; a document's vector is
the mean over its words; a softmax over the two labels follows. Table and
softmax are learnt together by stochastic gradient descent in numpy, over at
most ``TRAIN_ROWS`` labelled rows. Words keep their case, digits and symbols.

As the softmax is linear in the document's vector, a word's part of the margin
between the labels is one number; workers remember it for the words they met.

Defined results: null and empty texts get the score of a text without words;
without both labels among the training rows every score is the share of label 1
(one half without rows); a labelled id with several texts trains on each, one
with several labels on the largest; each input row gets a row, repeated rows
and rows without an id as well, and equal texts equal scores; long texts are
read whole, a word at a time; only doc_id and text are read; an empty table
gives no rows. The driver holds at most ``TRAIN_ROWS`` rows of at most
``BUCKETS`` entries of 6 bytes; texts of some thousand words have a few
thousand entries, 30 MB for all rows of the test data.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm._scratch import bound_batches, materialize, release
from tarnflow.llm._training import labelled

TRAIN_ROWS = 3000
BUCKETS, DIM = 1 << 16, 16
GRAMS = (2, 3, 4)
EPOCHS, RATE = 6, 0.5
CACHE_WORDS = 1_000_000
SEED = 17


def rows_of(word: str) -> np.ndarray:
    """Table rows of a word and of its character n-grams, with borders."""
    import xxhash

    w = f"<{word}>"
    forms = ["=" + w, *(w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1))]
    return np.array([xxhash.xxh3_64_intdigest(f) % BUCKETS for f in forms], np.int32)


class Words:
    """Distinct rows and weights of a document: how much of its vector each row makes."""

    def __init__(self):
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter((text or "").split())
        if len(self.known) > CACHE_WORDS // 8:
            self.known.clear()
        total = np.zeros(BUCKETS, np.float64)
        for word, n in counts.items():
            r = self.known.get(word)
            if r is None:
                r = self.known[word] = rows_of(word)
            np.add.at(total, r, n / len(r))
        at = np.flatnonzero(total)
        return at.astype(np.int32), (total[at] / max(1, sum(counts.values()))).astype(np.float32)


class Model:
    """The learnt table and softmax, kept as one margin for each table row."""

    def __init__(self, margin: np.ndarray, intercept: float):
        self.margin, self.intercept = margin.astype(np.float32), intercept


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Stochastic gradient descent over the documents in a seeded order."""
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    share = max(1, len(docs) * epochs)
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, weight = docs[i][0], docs[i][1].astype(np.float32)
            step = rate * (1 - done / share)
            done += 1
            rows = table[at]
            x = weight @ rows
            z = out @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= step * np.outer(p, x)
            bias -= step * p * 0.1
            if len(at):
                # rows of a long text share little of the mean each; the text moves them as one
                table[at] = rows - step * 20 * np.outer(weight, back)
    return Model(table @ (out[1] - out[0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", modulus: int = 4, remainder: int = 2, most: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows of ``docs`` outside the held-out fold."""
    spark = docs.sparkSession
    bound_batches(spark)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = [words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([w.astype(np.float16).tobytes() for _, w in found], pa.binary())], ["doc_id", "label", "at", "weight"])

    rows, path = materialize(spark, labelled(docs, labels, target, modulus, remainder, most).mapInArrow(extract, "doc_id bigint, label int, at binary, weight binary"), "quality-rows")
    table = rows.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()  # at most ``most`` rows, each of at most BUCKETS entries
    release(spark, path)
    y = np.array(table.column("label").to_pylist(), int)
    if len(set(y.tolist())) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    texts = [(np.frombuffer(a, np.int32), np.frombuffer(w, np.float16)) for a, w in zip(table.column("at").to_pylist(), table.column("weight").to_pylist(), strict=True)]
    del table
    return fit(texts, y)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, text: str | None) -> float:
        words = (text or "").split()
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        parts = list(map(known.get, words))
        if None in parts:
            margin = self.model.margin
            for i, p in enumerate(parts):
                if p is None:
                    w = words[i]
                    p = known.get(w)
                    if p is None:
                        p = known[w] = float(margin[rows_of(w)].mean())
                    parts[i] = p
        z = self.model.intercept + (sum(parts) / len(parts) if parts else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


_SCORERS: dict[str, Scorer] = {}


def scorer_of(key: str, shared) -> Scorer:
    """The worker's scorer of a model; it serves all tasks of the process, so that its words stay known."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(shared.value)
    return _SCORERS[key]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(key, shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
