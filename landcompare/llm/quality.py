"""Quality by ordinal cumulative-link regression on graded ratings.

Grades 0..K-1 share one vector of hashed-text weights; ordered thresholds cut its score:
P(grade <= k) = logistic(threshold_k - score). The expected grade and the probability of
a grade or better follow from it; the latter selects.

The test tables grade documents by two marks: 0 for low quality, 1 for quality with
toxic words, 2 for quality without. Documents are selected at grade 1 or better.

Features: hashed lower-case tokens (logarithm of their count, the text scaled to unit
length), shapes of tokens (letters, capitals, digits and signs in runs) and a few
figures of the text in steps. The fit takes a bounded sample: the ``MAX_ROWS`` labelled
documents with the smallest hashes of their ids, in one task, mini-batches by AdaGrad.
Scoring reads every text whole.

Rows: null text counts as empty, null ids stay, repeated rows each get their score.
Ratings: nulls are left out, the largest of a repeated id counts. Without ratings every
grade is as likely as the others. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landcompare.llm.common import table, texts
from landcompare.llm.toxicity import pieces, training_rows

GRADES, SELECTED_GRADE, THRESHOLD = 3, 1, 0.5
MAX_ROWS = 12_000
BUCKETS = 1 << 18
EPOCHS, RATE, BATCH, L2 = 8, 0.5, 64, 1e-6
MEMO, ENTRY = 24 << 20, 64  # letters remembered, each token counting for some more

LETTERS, CAPITAL = re.compile(r"[^\W\d_]+"), re.compile("[A-ZÀ-Þ]")
RUNS = [(LETTERS, lambda run: "A" if CAPITAL.search(run[0]) else "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1\1")]


class Features:
    """(buckets, values) of a text, of unit length besides the shapes and figures."""

    def __init__(self):
        self.memo: dict[str, tuple[int, int]] = {}
        self.held = 0

    def _of(self, token: str) -> tuple[int, int]:
        self.held += len(token) + ENTRY
        if self.held > MEMO:
            self.memo.clear()
            self.held = len(token) + ENTRY
        shape = "AA" if token.isupper() and len(token) > 1 else token
        for pattern, run in RUNS:
            shape = pattern.sub(run, shape)
        found = _bucket("w", token.lower()), _bucket("s", shape)
        self.memo[token] = found
        return found

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts: Counter[str] = Counter()
        for piece in pieces(text):
            counts.update(piece.split())
        total = sum(counts.values())
        words: dict[int, int] = {}
        shapes: dict[int, int] = {}
        for token, n in counts.items():
            word, shape = self.memo.get(token) or self._of(token)
            words[word] = words.get(word, 0) + n
            shapes[shape] = shapes.get(shape, 0) + n
        values = np.log1p(np.fromiter(words.values(), float, len(words)))
        values /= np.linalg.norm(values) or 1.0
        shares = np.fromiter(shapes.values(), float, len(shapes)) / max(total, 1)
        letters = sum(len(t) * n for t, n in counts.items())
        figures = (
            _bucket("distinct", str(int(10 * len(counts) / max(total, 1)))),
            _bucket("length", str(int(math.log2(total + 1)))),
            _bucket("letters", str(min(20, letters // max(total, 1)))),
        )
        at = np.fromiter((*words, *shapes, *figures), np.int32, len(words) + len(shapes) + 3)
        return at, np.concatenate([values, shares, np.full(3, 0.3)])


def _bucket(kind: str, token: str) -> int:
    return zlib.crc32(f"{kind}:{token}".encode()) * 0x9E3779B1 % (1 << 32) >> (32 - (BUCKETS.bit_length() - 1))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the largest likelihood; thresholds ascend as their gaps are exponentials."""
    w, w_rate = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    # Start where the grades' shares put the thresholds.
    shares = (np.bincount(grades, minlength=n_grades) + 1.0) / (len(grades) + n_grades)
    below = np.clip(np.cumsum(shares)[:-1], 1e-3, 1 - 1e-3)
    cuts = np.log(below / (1 - below))
    free = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    free_rate = np.full(len(free), 1e-8)
    for _ in range(EPOCHS if rows else 0):
        for start in range(0, len(rows), BATCH):
            batch, y = rows[start : start + BATCH], grades[start : start + BATCH]
            at = np.concatenate([r[0] for r in batch])
            x = np.concatenate([r[1] for r in batch])
            owner = np.repeat(np.arange(len(batch)), [len(r[0]) for r in batch])
            s = np.bincount(owner, w[at] * x, len(batch))
            cuts = thresholds(free)
            edges = np.concatenate([[-np.inf], cuts, [np.inf]])
            lo, hi = logistic(edges[y] - s), logistic(edges[y + 1] - s)
            p = np.maximum(hi - lo, 1e-9)
            slope = (hi + lo - 1) / len(batch)  # of the log-likelihood by the score
            g = np.bincount(at, slope[owner] * x, BUCKETS)
            hit = np.unique(at)
            step = g[hit] - L2 * w[hit]
            w_rate[hit] += step**2
            w[hit] += RATE * step / np.sqrt(w_rate[hit])
            by_cut = np.zeros(n_grades - 1)
            top, bottom = y < n_grades - 1, y > 0
            np.add.at(by_cut, y[top], (hi * (1 - hi) / p)[top] / len(batch))
            np.add.at(by_cut, y[bottom] - 1, -(lo * (1 - lo) / p)[bottom] / len(batch))
            by_free = np.cumsum(by_cut[::-1])[::-1] * np.concatenate([[1.0], np.exp(free[1:])])
            free_rate += by_free**2
            free += 0.05 * by_free / np.sqrt(free_rate)
    return w, thresholds(free)


def thresholds(free: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int = GRADES, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, weights, thresholds) from ratings (doc_id, grade 0..n_grades-1)."""

    def learn(batches):
        features, rows, grades = Features(), [], []
        for batch in batches:
            grades += batch.column("label").to_pylist()
            rows += [features(t) for t in batch.column("text").to_pylist()]
        w, cuts = fit_rows(rows, np.clip(np.array(grades, np.int64), 0, n_grades - 1), n_grades)
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(np.append(at, -1 - np.arange(len(cuts))).astype(np.int32)), pa.array(np.append(w[at], cuts))], ["bucket", "weight"])

    # One task for a sample of bounded size, in an order that depends on the ids alone.
    sample = training_rows(docs, ratings, "grade", max_rows).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    model = sample.select("label", "text").mapInArrow(learn, "bucket INT, weight DOUBLE").toPandas().sort_values("bucket")
    cuts = model[model.bucket < 0].weight.to_numpy()[::-1]
    model = model[model.bucket >= 0]
    if not len(cuts):  # no ratings: all grades alike
        cuts = np.log(np.arange(1, n_grades) / np.arange(n_grades - 1, 0, -1))
    return model.bucket.to_numpy(), model.weight.to_numpy(), cuts


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], selected_grade: int = SELECTED_GRADE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, selected) of every row; the tail is of ``selected_grade`` or better."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS weights

    def run(batches):
        w = features = None
        for batch in batches:
            if w is None:
                buckets, weights, cuts = shared.value
                w, features = np.zeros(BUCKETS), Features()
                w[buckets] = weights
            s = np.array([w[at] @ x for at, x in map(features, batch.column("text").to_pylist())])
            better = 1 - logistic(cuts[None, :] - s.reshape(-1, 1))
            tail = better[:, selected_grade - 1]
            columns = [batch.column("doc_id"), pa.array(better.sum(1)), pa.array(tail), pa.array(tail >= threshold)]
            yield pa.record_batch(columns, ["doc_id", "expected_grade", "tail_probability", "selected"])

    return texts(docs).mapInArrow(run, "doc_id BIGINT, expected_grade DOUBLE, tail_probability DOUBLE, selected BOOLEAN")


def ratings_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from the marks of the test tables; null where a mark is missing."""
    clean = F.when(F.col("toxic") > 0, 0).when(F.col("toxic") <= 0, 1)
    return labels.select("doc_id", F.when(F.col("quality") <= 0, 0).when(F.col("quality") > 0, 1 + clean).alias("grade"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, ratings_of(table(spark, sf_dir, "labels"))))
