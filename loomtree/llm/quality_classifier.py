"""A quality classifier for graded ratings: ordinal cumulative-link regression over hashed text.

P(grade <= k) = sigmoid(threshold[k] - score): one weight vector, shared by all grades, gives the score, and ordered
thresholds cut it into grades. The expected grade and the tail probability P(grade >= 2) come from the same model.

Features are hashed, and present or absent in a document: lower-cased words, pairs of neighbouring words, the last byte of a
word, and whether a word repeats the one before it. Only features that go with the grades get a weight: a score test against
each cut between grades must reach LEAST_SCORE, so that a few telling words aren't lost among all words of a long text. The
model is fitted on at most MAX_LABELLED rated documents, chosen by a hash of their ids; scoring reads every document, whole,
without a shuffle.

Defined results: null and empty texts have score 0; ratings with a null part and of unknown documents are left out; different
grades of a document are all used, equal ones once, and of several texts of a rated doc_id the least; without two distinct grades the model says the one grade (or 0) always; an
empty table gives no rows; other columns pass through, but for names that
the operator writes itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtree.llm.common import flat_bytes, mixed, pieces, rest_of, word_hashes

MAX_LABELLED = 8192
BITS = 18
GRADES = 3
#: A document is kept if its probability of the best grade is at least this.
KEEP = 0.5
#: A feature gets a weight if so many rated documents have it and its score test (chi squared, one degree of freedom) is so large.
MIN_DOCUMENTS = 3
LEAST_SCORE = 20.0


def features(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature, row by row, and the offsets of the rows' features."""
    words, rows, _, stops = word_hashes(flat, offsets, lower=True)
    n = len(words)
    first = np.zeros(n, bool)
    first[rows[:-1][rows[:-1] < n]] = True
    last = np.concatenate([np.zeros(1, np.uint64), words[:-1]]) if n else words
    last[first] = np.uint64(0)
    with np.errstate(over="ignore"):
        pair = mixed(last * np.uint64(3) + words, 2)
    ending = mixed(flat[stops - 1].astype(np.uint64) if n else words, 3)
    again = mixed((last == words).astype(np.uint64), 4)
    buckets = np.stack([words, pair, ending, again], axis=1) >> np.uint64(64 - BITS)
    return buckets.astype(np.int64).ravel(), rows * 4


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tail(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))

    def scores(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        buckets, rows = features(flat, offsets)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        heavy = self.weights[buckets] != 0
        present = np.unique(row[heavy] << BITS | buckets[heavy])
        return np.bincount(present >> BITS, self.weights[present & ((1 << BITS) - 1)], minlength=len(rows) - 1)


def telling(rows: list[tuple[int, np.ndarray]], grades: int) -> np.ndarray:
    """Whether each bucket's presence goes with grade >= k for some k."""
    grade, n = np.array([g for g, _ in rows]), len(rows)
    at = np.concatenate([b for _, b in rows]).astype(np.int64)
    of = np.repeat(grade, [len(b) for _, b in rows])
    have = np.bincount(at, minlength=1 << BITS)
    best = np.zeros(1 << BITS)
    for k in range(1, grades):
        share = (grade >= k).mean()
        spread = have * (share * (1 - share)) * (1 - have / n)
        off = np.bincount(at[of >= k], minlength=1 << BITS) - have * share
        best = np.maximum(best, np.where(spread > 0, off * off / np.maximum(spread, 1e-12), 0))
    return (best >= LEAST_SCORE) & (have >= MIN_DOCUMENTS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def thresholds_of(steps: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, and how far each lies above the one before, as exponentials."""
    return np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))


def likelihood(weights: np.ndarray, steps: np.ndarray, y: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades y, and its gradients by weights and steps. at, row: the buckets of all documents and whose they are.

    P(y) = sigmoid(threshold[y] - score) - sigmoid(threshold[y - 1] - score), the outer thresholds at the ends of the line.
    """
    grades, n = len(steps) + 1, len(y)
    score, theta = np.bincount(row, weights[at], minlength=n), thresholds_of(steps)
    upper, lower = _sigmoid(np.append(theta, 500.0)[y] - score), _sigmoid(np.insert(theta, 0, -500.0)[y] - score)
    p = np.maximum(upper - lower, 1e-9)
    by_weights = np.bincount(at, (1 - upper - lower)[row], minlength=len(weights)) / n
    by_theta = np.zeros(grades)
    np.add.at(by_theta, y, -upper * (1 - upper) / p)
    np.add.at(by_theta, y - 1, np.where(y > 0, lower * (1 - lower) / p, 0))
    by_steps = np.cumsum(by_theta[:-1][::-1])[::-1] / n
    by_steps[1:] *= np.exp(steps[1:])
    return float(-np.log(p).mean()), by_weights, by_steps


def fit(rows: list[tuple[int, np.ndarray]], grades: int = GRADES, epochs: int = 60, batch: int = 256, rate: float = 0.3, decay: float = 3e-5, seed: int = 5) -> Ordinal:
    """rows: (grade, the distinct buckets of a document). Adagrad on the negative log-likelihood; thresholds stay ordered by exponential steps."""
    weights = np.zeros(1 << BITS)
    seen = np.bincount([g for g, _ in rows], minlength=grades) if rows else np.zeros(grades, int)
    if (seen > 0).sum() < 2:
        only = int(seen.argmax())
        return Ordinal(weights.astype(np.float32), np.array([-30.0 + 1e-3 * k if k < only else 30.0 + 1e-3 * k for k in range(grades - 1)]))
    chosen = telling(rows, grades)
    rows = [(g, b[chosen[b]].astype(np.int64)) for g, b in rows]
    share = np.clip(np.cumsum(seen)[:-1] / len(rows), 1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    steps = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    g2w, g2t, rng = np.full(1 << BITS, 1e-8), np.full(grades - 1, 1e-8), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = [rows[i] for i in order[k : k + batch]]
            row = np.repeat(np.arange(len(part)), [len(b) for _, b in part])
            _, gw, gs = likelihood(weights, steps, np.array([g for g, _ in part]), np.concatenate([b for _, b in part]), row)
            gw += decay * weights
            g2w += gw * gw
            g2t += gs * gs
            weights -= rate * gw / np.sqrt(g2w)
            steps -= 0.1 * gs / np.sqrt(g2t)
    return Ordinal(weights.astype(np.float32), thresholds_of(steps))


def fit_on(docs: DataFrame, ratings: DataFrame, text: str = "text", doc_id: str = "doc_id", max_labelled: int = MAX_LABELLED) -> Ordinal:
    """Fits on documents with a rating: ratings has doc_id and grade (0 to GRADES - 1)."""
    chosen = ratings.where(F.col("grade").isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("_id"), "grade")
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("_id"), "_id", "grade").limit(max_labelled))  # max_labelled rows of 12 bytes
    rated = docs.select(docs[doc_id].cast("long").alias("_id"), docs[text].cast("string").alias("text")).join(chosen, "_id")
    rated = rated.groupBy("_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")  # at most max_labelled rows, however often an id repeats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                buckets, rows = features(*flat_bytes(part.column("text")))
                at = [np.unique(buckets[a:b]).astype("<u4").tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array(at, pa.binary())], ["grade", "at"])

    found = rated.select(F.col("grade").cast("int").alias("grade"), "text").mapInArrow(run, "grade int, at binary")
    rows = [(r["grade"], np.frombuffer(r["at"], "<u4")) for r in found.toLocalIterator()]
    return fit(sorted(rows, key=lambda r: (r[0], r[1].tobytes())))


def classify(docs: DataFrame, model: Ordinal, text: str = "text", keep: float = KEEP) -> DataFrame:
    """docs without text, with expected_grade, tail_prob (of the best grade) and kept."""
    rest = rest_of(docs, text, "expected_grade", "tail_prob", "kept")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*rest).schema.add("expected_grade", "double").add("tail_prob", "double").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                tail = shared.value.tail(shared.value.scores(*flat_bytes(part.column(text))))
                made = [pa.array(tail.sum(axis=1)), pa.array(tail[:, -1]), pa.array(tail[:, -1] >= keep)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *made], [*rest, "expected_grade", "tail_prob", "kept"])

    return docs.select(*rest, docs[text].cast("string").alias(text)).mapInArrow(run, schema)
