"""Quality by compression: zstandard dictionaries of good and of bad text, and how much better one serves than the other.

A bounded sample of labelled rows trains a dictionary for each class (three rows of four, by their id's
hash) and calibrates (the rest): the difference (bad size - good size) / (bad size + good size) of the
compressed text, with the text's length and how far both sizes fall below it, goes through a logistic
curve fitted by Newton's method, in which each class weighs as it does among all labelled rows. Every
document is compressed whole.

Without rows of both classes every score is the share of good rows (n + 1 of n + m + 2). Nulls: a null
text counts as empty and gets a score like any other, a null doc_id is kept. Repeated rows each give a
row. Empty tables give empty results. Other columns are never read.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import modest_batches, sliced
from vellum.llm.labelled import in_fold, sample_class

ROWS_PER_CLASS, DICTIONARY_BYTES, LEVEL, CHUNK = 3000, 65_536, 3, 2000
CUT = 0.5


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]  # of measures(), then the base
    level: int = LEVEL

    def scorer(self):
        *weights, base = self.weights
        if not weights:
            return lambda text: 1 / (1 + math.exp(-base))
        made = compressors(self.good, self.bad, self.level)
        return lambda text: 1 / (1 + math.exp(-min(40.0, max(-40.0, base + sum(map(operator.mul, weights, measures(made, text)))))))


def compressors(good: bytes, bad: bytes, level: int) -> list:
    import zstandard

    return [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) for d in (good, bad)]


def measures(made: list, text: bytes) -> tuple[float, float, float]:
    good, bad = (len(c.compress(text)) for c in made)
    return (bad - good) / (bad + good), math.log1p(len(text)), (bad + good) / (len(text) + 10)


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too little text for training, the text itself."""
    import zstandard

    chunks = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    try:
        return zstandard.train_dictionary(size, chunks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[:size] or b" " * 8


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> list[float]:
    """Weights of x's columns and the base of P(y = 1) by Newton's method, with a small ridge in units of each column's spread."""
    middle, spread = x.mean(0), x.std(0) + 1e-9
    a, w = np.column_stack([(x - middle) / spread, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    weight = weight / weight.mean()
    hold = ridge * len(x) * np.eye(len(w))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + hold, a.T @ (weight * (p - y)) + hold @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return [*(w[:-1] / spread), float(w[-1] - (w[:-1] / spread) @ middle)]


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, size: int = DICTIONARY_BYTES, level: int = LEVEL) -> Model:
    """labels: doc_id, quality. Only a sample of at most `rows` for each class comes to the driver."""
    by = {q: sample_class(docs, labels, "quality", q, rows, "quality") for q in (1, 0)}
    there = labels.agg(*(F.count(F.when(F.col("quality") == q, 1)).alias(f"n{q}") for q in (1, 0))).first()
    teaches = lambda i: zlib.crc32(f"quality {i}".encode()) % 4 > 0
    teach, rest = ({q: [t for i, t in x if teaches(i) == k] for q, x in by.items()} for k in (True, False))
    if not (all(teach.values()) and all(rest.values())):
        return Model(b"", b"", [math.log((there["n1"] + 1) / (there["n0"] + 1))])
    dicts = [dictionary(teach[q], size) for q in (1, 0)]
    made = compressors(*dicts, level)
    x = np.array([measures(made, t) for q in (1, 0) for t in rest[q]])
    y = np.array([float(q) for q in (1, 0) for _ in rest[q]])
    return Model(*dicts, logistic(x, y, np.array([there[f"n{q}"] / len(rest[q]) for q in (1, 0) for _ in rest[q]])), level)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in sliced(batches):
            yield pa.record_batch([batch.column(0), pa.array([score(t.as_py() or b"") for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of the held-out fold are never read."""
    learn = labels.where(~in_fold(labels["doc_id"], modulus, remainder)).select("doc_id", "quality")
    found = scored(docs, train(docs, learn))
    return found.select("doc_id", in_fold(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
