"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, pairs of neighbouring words and pairs with
one word between, each hashed to a bucket. FTRL-proximal keeps a learning rate per
coordinate and an L1 threshold that leaves most weights at zero, so the model is a
short list of buckets, small enough to broadcast whatever the number of documents.

It is fitted in one task on a bounded sample: the ``MAX_ROWS`` labelled documents with
the smallest hashes of their ids. Scoring reads every text whole, in pieces.

Rows: null text counts as empty and gets the score of the bias, null ids stay (they
count as not held out and never have a label), repeated rows each get their score.
Labels: nulls are left out, the largest of repeated labels counts, anything above zero
is toxic. Without any label every score is 0.5. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landcompare.llm.common import few, frugal, packed, table, texts

MAX_ROWS = 12_000
BUCKETS = 1 << 20
EPOCHS, ALPHA, BETA, L1, L2 = 6, 2.0, 1.0, 8.0, 0.0
THRESHOLD = 0.7

WORD = re.compile(r"\w+")
PIECE = 1 << 20
MEMO = 1 << 20


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about a million characters, cut at white space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


class Grams:
    """Distinct buckets of a text's words, pairs and skip pairs."""

    def __init__(self, buckets: int = BUCKETS):
        self.shift = np.uint64(64 - (buckets.bit_length() - 1))
        self.memo: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for word in {w for w in words if w not in memo}:
            data = word.encode()
            memo[word] = zlib.crc32(data) << 32 | zlib.crc32(data[::-1])
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str) -> np.ndarray:
        odd, skip = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        found, last = [], np.zeros(0, np.uint64)
        for piece in pieces(text.lower()):
            one = self._hashes(WORD.findall(piece))
            run = np.concatenate([last, one])
            mixed = np.concatenate([one * odd, (run[:-1] * skip + run[1:]) * odd, (run[:-2] * odd + run[2:] + skip) * odd])
            found.append(np.unique(mixed >> self.shift))
            last = run[-2:]
        return (found[0] if len(found) == 1 else np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))).astype(np.int32)


def ftrl(rows: list[np.ndarray], labels: list[int], buckets: int = BUCKETS) -> tuple[float, np.ndarray]:
    """(bias, weights); the bias has no L1 threshold."""
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)
    l1, l2 = np.full(buckets + 1, L1), np.full(buckets + 1, L2)
    l1[buckets] = l2[buckets] = 0.0

    def weights(at) -> np.ndarray:
        shrunk = np.maximum(np.abs(z[at]) - l1[at], 0.0)
        return -np.sign(z[at]) * shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + l2[at])

    for _ in range(EPOCHS):
        for row, label in zip(rows, labels, strict=True):
            at = np.append(row, buckets)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            old = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - old) / ALPHA * w
    found = weights(np.arange(buckets + 1))
    return float(found[buckets]), found[:buckets]


def held_out(doc_id: Column) -> Column:
    """Whether no label of this document may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of the sample; one row per id, its smallest text if it has several."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = texts(docs).join(F.broadcast(marks), "doc_id")  # at most max_rows pairs of numbers
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, buckets, weights) with the zero weights left out."""

    def hashed(batches):
        grams = Grams()
        for batch in few(batches):
            found = [grams(t) for t in batch.column("text").to_pylist()]
            offsets = np.cumsum([0, *map(len, found)])
            lists = pa.LargeListArray.from_arrays(offsets, pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), lists.cast(pa.list_(pa.int32()))], ["doc_id", "label", "grams"])

    def learn(batches):
        rows, marks = [], []
        for batch in batches:
            marks += [int(x > 0) for x in batch.column("label").to_pylist()]
            rows += [x.values.to_numpy() for x in batch.column("grams")]
        bias, weights = ftrl(rows, marks) if rows else (0.0, np.zeros(BUCKETS))
        at = np.flatnonzero(weights).astype(np.int32)
        yield pa.record_batch([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(weights[at], bias))], ["bucket", "weight"])

    sample = training_rows(docs, labels, label, max_rows).mapInArrow(frugal(hashed), "doc_id BIGINT, label INT, grams ARRAY<INT>")
    # One task for a sample of bounded size, in an order that depends on the ids alone.
    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    model = ordered.mapInArrow(frugal(learn), "bucket INT, weight DOUBLE").toPandas().sort_values("bucket")
    bias = float(model.weight[model.bucket == -1].sum())
    model = model[model.bucket >= 0]
    return bias, model.bucket.to_numpy(), model.weight.to_numpy()


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    return _scored(texts(docs), model, threshold, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def _scored(rows: DataFrame, model, threshold: float, kept: list[str]) -> DataFrame:
    """The kept columns with score and predicted; the text is a column or a field of the column ``row``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS weights, mostly far fewer

    def run(batches):
        weights = grams = None
        for batch in few(batches):
            if weights is None:
                bias, buckets, values = shared.value
                weights, grams = np.zeros(BUCKETS), Grams()
                weights[buckets] = values
            found = batch.column("row").field("text") if "row" in kept else batch.column("text")
            sums = np.array([bias + weights[grams(t or "")].sum() for t in found.to_pylist()])
            found = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            columns = [*(batch.column(c) for c in kept), pa.array(found), pa.array((found >= threshold).astype(np.int32))]
            yield pa.record_batch(columns, [*kept, "score", "predicted"])

    more = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return rows.mapInArrow(frugal(run), T.StructType([*(rows.schema[c] for c in kept), *more]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, in one pass over them."""
    return _scored(packed(docs).select("row"), fit(docs, labels), threshold, ["row"]).where("predicted = 0").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
