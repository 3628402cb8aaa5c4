"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Every word bucket has a fixed sparse random index vector.  A bucket's word vector is its own index vector plus the
index vectors of its neighbours in the fit sample (random indexing).  A document is the mean and the
spread of its words' vectors.  The network's logit is divided by a temperature that is fitted on rows it has not
seen, so that its outputs are probabilities.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WordCache, id_text, texts_of

#: Rows that the classifier is fitted on at most: those of smallest id hash among the labelled ones of the
#: learning folds.  A documented bound, the same at every size.
FIT_ROWS = 3000
FOLDS = 5
THRESHOLD = 0.3
BUCKETS, DIM, NONZERO, HIDDEN = 1 << 14, 48, 6, 24
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def bucket_of(token: str) -> int:
    """Bucket of a token: words by their lower-case form, marked as shouted or not; digits and
    marks by their shape."""
    if token[0].isdigit():
        shape = "0"
    elif token[0].isalpha():
        shape = token.lower() + ("^" if len(token) > 1 and token.isupper() else "")
    else:
        shape = token[:4]
    return zlib.crc32(shape.encode("utf-8", "replace")) % (BUCKETS - 1) + 1


class QualityModel:
    """Fitted vectors, network and temperature: a few megabytes, whatever the corpus."""

    def __init__(self, texts: list[str], labels: list[int], seed: int = 7):
        rng = np.random.default_rng(seed)
        index = np.zeros((BUCKETS, DIM), np.float32)
        for k in range(NONZERO):
            index[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] = 1 - 2 * (k % 2)
        self.buckets = WordCache(bucket_of)
        rows = [self.words(t) for t in texts]
        self.vectors = self._word_vectors(rows, index)
        x = np.array([self.pooled(r) for r in rows], np.float32).reshape(len(rows), 2 * DIM + 3)
        y = np.array(labels, np.float32)
        self.mean, self.spread = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(2 * DIM + 3), np.ones(2 * DIM + 3))
        x = (x - self.mean) / self.spread
        self.w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN))
        self.b1, self.w2, self.b2, self.temperature = np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), 0.0, 1.0
        if len(set(labels)) < 2:  # nothing to tell apart
            self.w2[:], self.b2 = 0.0, 4.0 if (labels or [1])[0] == 1 else -4.0
            return
        check = np.arange(len(x)) % 5 == 0
        self._train(x[~check], y[~check], rng)
        self._calibrate(x[check], y[check])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "buckets"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.buckets = WordCache(bucket_of)

    def words(self, text: str) -> np.ndarray:
        found = TOKEN.findall(text)
        return np.fromiter(map(self.buckets.__getitem__, found), np.int32, len(found))

    @staticmethod
    def _word_vectors(rows: list[np.ndarray], index: np.ndarray) -> np.ndarray:
        flat = np.concatenate([np.append(r, 0) for r in rows]) if rows else np.zeros(1, np.int32)  # 0 parts documents
        context = np.zeros_like(index, np.float64)
        for d in range(DIM):
            for here, there in ((flat[1:], flat[:-1]), (flat[:-1], flat[1:])):
                context[:, d] += np.bincount(here, weights=index[there, d], minlength=BUCKETS)
        context /= np.linalg.norm(context, axis=1, keepdims=True) + 1e-9
        vectors = (index / np.sqrt(NONZERO) + context).astype(np.float32)
        vectors[0] = 0
        return vectors

    def pooled(self, words: np.ndarray) -> np.ndarray:
        """Mean and spread of the word vectors, length, share of different words, share of words like the one before."""
        n = len(words)
        if not n:
            return np.zeros(2 * DIM + 3, np.float32)
        ids, counts = np.unique(words, return_counts=True)
        rows, weight = self.vectors[ids], (counts / n).astype(np.float32)
        mean = weight @ rows
        spread = np.sqrt(np.maximum(weight @ (rows * rows) - mean * mean, 0))
        return np.concatenate([mean, spread, [np.log1p(n), len(ids) / n, float((words[1:] == words[:-1]).sum()) / n]])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def _train(self, x: np.ndarray, y: np.ndarray, rng, epochs: int = 30, rate: float = 0.01, decay: float = 1e-4) -> None:
        """Adam on the cross-entropy, both classes weighted alike."""
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        names = ("w1", "b1", "w2", "b2")
        m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for rows in np.array_split(order, max(1, len(x) // 64)):
                xb, h = x[rows], np.tanh(x[rows] @ self.w1 + self.b1)
                error = (1 / (1 + np.exp(-(h @ self.w2 + self.b2))) - y[rows]) * weight[rows] / len(rows)
                back = np.outer(error, self.w2) * (1 - h * h)
                grads = {"w1": xb.T @ back + decay * self.w1, "b1": back.sum(axis=0), "w2": h.T @ error + decay * self.w2, "b2": error.sum()}
                t += 1
                for k, g in grads.items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Temperature and offset (from the weighted classes back to their real shares) of least cross-entropy."""
        z = self._logit(x)
        best = (np.inf, 1.0, 0.0)
        for temperature in np.geomspace(0.5, 8, 25):
            for shift in np.linspace(-2, 2, 17):
                p = np.clip(1 / (1 + np.exp(-np.clip(z / temperature + shift, -30, 30))), 1e-6, 1 - 1e-6)
                best = min(best, (-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(), temperature, shift))
        self.temperature, self.b2 = best[1], self.b2 + best[2] * best[1]

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text."""
        if not texts:
            return np.zeros(0)
        x = (np.array([self.pooled(self.words(t)) for t in texts]) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled documents outside the held-out fold; only ``quality`` is read as a label.

    The ids are chosen before any text is read: those of smallest hash (a bounded top-k).  Repeated labels count once; an
    id with both labels is left out, so the order of rows does not matter."""
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    sample = (id_text(docs).join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows of two numbers
              .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "quality")
              .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).collect())
    return QualityModel([r["text"] for r in sample], [r["quality"] for r in sample])


def classify(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text, one row per input row.

    Null text counts as empty and gets the score of an empty text; a null ``doc_id`` counts as not held out;
    repeated rows are scored each, alike; other columns are ignored; an empty table gives an empty result.
    One pass over the scan's partitions; the model is sent to the tasks once (a few megabytes).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for batch in batches:
            p = m.score(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()),
                                              pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return (id_text(docs).select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
            .mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int"))
