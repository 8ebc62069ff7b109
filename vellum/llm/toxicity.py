"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives and a sample of any documents is unlabelled; a linear model on
the presence of words and of their beginnings is trained in numpy on the risk

    prior * E_positive[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_positive[loss(-)])

with logistic loss; where the bracket turns negative its gradient is undone instead (Kiryo and others,
2017). The class prior is the share of toxic rows among the labelled ones outside the held-out fold.
Features are those of the positives' words whose share differs most from the unlabelled sample's. Every
document is scored by all words of its whole text.

Without positives every score is 0. Nulls: a null text counts as empty and gets a score like any other,
a null doc_id is kept. Repeated rows each give a row. Empty tables give empty results. Other columns
are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import modest_batches, quoted, sliced
from vellum.llm.labelled import in_fold, sample_class, sample_unlabelled

POSITIVES, UNLABELLED = 2000, 5000
MORE_USUAL, LESS_USUAL, LEAST_ROWS, LEAST_LIFT = 400, 100, 3, 2.0
BEGINNINGS = (4, 5, 6)
#: The ridge; with few positives it is FEW / their number. FEW and LEAST_LIFT are the best of nine pairs by the sum of two F1 values of a
#: four-fold cross-validation inside the training folds of sf0.1, with all its positives and with 40 of them; no held-out label took part.
RIDGE, FEW, STEPS, RATE = 1e-3, 1.5, 250, 0.05
CUT = 0.3

letters = re.compile(r"[^\W\d_]+").findall


def words_of(text: bytes | None) -> set[str]:
    return set(letters((text or b"").decode("utf-8", "replace").lower()))


def features(text: bytes | None) -> set[str]:
    """The words of a text and their beginnings, which are marked by a caret."""
    words = words_of(text)
    return words.union(*({"^" + w[:n] for w in words if len(w) >= n} for n in BEGINNINGS))


@dataclass
class Model:
    weights: dict[str, float]
    base: float

    def scorer(self):
        words = {k: v for k, v in self.weights.items() if k[0] != "^"}
        begins = [(n, {k[1:]: v for k, v in self.weights.items() if k[0] == "^" and len(k) == n + 1}) for n in BEGINNINGS]

        def score(text: bytes | None) -> float:
            there, total = words_of(text), self.base
            total += sum(words[w] for w in there & words.keys()) if len(there) > len(words) else sum(words[w] for w in there if w in words)
            for n, known in begins:
                total += sum(known[b] for b in {w[:n] for w in there} if b in known)
            return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))

        return score


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, b: float, prior: float, ridge: float = 0.0) -> tuple[float, np.ndarray]:
    """The risk of positive rows xp and unlabelled rows xu, and its gradient (weights, then base); that of the bracket alone, turned round, where the bracket is negative."""
    sp, su = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
    bracket = -np.log(1 - su + 1e-9).mean() + prior * np.log(1 - sp + 1e-9).mean()
    p_minus, u_minus = prior * sp / len(xp), su / len(xu)
    gp, gu = (prior * (sp - 1) / len(xp) - p_minus, u_minus) if bracket >= 0 else (p_minus, -u_minus)
    value = prior * -np.log(sp + 1e-9).mean() + max(0.0, bracket) + ridge / 2 * float(w @ w)
    return float(value), np.append(gp.astype(np.float32) @ xp + gu.astype(np.float32) @ xu + ridge * w, gp.sum() + gu.sum())


def fit(positive: list[bytes], unlabelled: list[bytes], prior: float) -> Model:
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model({}, 40.0 if prior >= 1 and positive else -40.0)
    # only counts are held, and of the unlabelled only those of the positives' features
    often = Counter(f for t in positive for f in features(t))
    often = {f: c for f, c in often.items() if c >= LEAST_ROWS}
    seen = [often, Counter(f for t in unlabelled for f in features(t) if f in often)]
    n = [len(positive), len(unlabelled)]

    def lift(f: str) -> float:
        p, u = (c[f] / k for c, k in zip(seen, n))
        return (p - u) / np.sqrt(p / n[0] + u / n[1] + 1e-9)

    lifts = {f: x for f in often if abs(x := lift(f)) >= LEAST_LIFT}
    order = sorted(lifts, key=lambda f: (-lifts[f], f))
    chosen = list(dict.fromkeys([f for f in order[:MORE_USUAL] if lifts[f] > 0] + [f for f in order[-LESS_USUAL:] if lifts[f] < 0]))
    place = {f: i for i, f in enumerate(chosen)}
    xs = []
    for rows in (positive, unlabelled):
        x = np.zeros((len(rows), len(chosen)), np.float32)
        for i, t in enumerate(rows):
            x[i, [place[f] for f in features(t) if f in place]] = 1
        xs.append(x)
    xp, xu = xs
    w, b = np.zeros(len(chosen), np.float32), float(np.log(prior / (1 - prior)))
    m, v, ridge = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), max(RIDGE, FEW / n[0])
    for t in range(1, STEPS + 1):
        _, g = risk(xp, xu, w, b, prior, ridge)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), float(b - step[-1])
    return Model({f: float(x) for f, x in zip(chosen, w)}, b)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """labels: doc_id, toxic. At most positives + unlabelled rows come to the driver; the unlabelled ones are read without labels."""
    known = labels.where(~in_fold(labels["doc_id"], modulus, remainder)).select("doc_id", "toxic")
    prior = known.agg(F.avg("toxic").alias("x")).first()["x"] or 0.0
    return fit([t for _, t in sample_class(docs, known, "toxic", 1, positives, "toxic")], [t for _, t in sample_unlabelled(docs, unlabelled, "toxic")], prior)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All rows of docs' doc_id and text, with score."""
    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in sliced(batches):
            yield pa.record_batch([batch.column(0), pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs whose score is below the cut, unchanged, whatever their other columns are called."""
    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in sliced(batches):
            yield batch.filter(pa.array([score(None if t is None else str(t).encode()) < cut for t in batch.column(0).to_pylist()], pa.bool_()))

    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(docs["text"], F.struct(*(docs[quoted(c)].alias(c) for c in rest)).alias("rest"))
    kept = rows.mapInArrow(run, rows.schema)
    return kept.select(*((F.col("text") if c == "text" else F.col("rest").getField(c)).alias(c) for c in docs.columns))


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of the held-out fold are never read."""
    found = scored(docs, train(docs, labels, modulus, remainder))
    return found.select("doc_id", in_fold(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
