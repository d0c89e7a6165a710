"""Benchmark decontamination by BM25 with block maxima, every training passage being a query.

Test items form an inverted index with BM25 weights, each item's weights divided by the
score that its own text would get, so a passage with all of an item's words scores 1.
Items lie in blocks; for each word and block the index holds the largest weight. A
passage's bound for a block is the sum of its words' maxima: blocks whose bound stays
below the threshold hold no item to retrieve and are skipped, all others are opened and
scored exactly. That is block-max WAND over fixed ranges of items with a fixed threshold,
in which the pivot step skips whole ranges; nothing above the threshold is missed.

Passages are windows of twice the longest item's words, starting after every such
number of words, so an item in a text lies whole in one of them. What is retrieved is
verified on the words themselves: of the item's runs of five words, four fifths must
stand in the passage. The share is given for question (all up to the last sentence),
answer (the last sentence) and both.

Counts and lengths are taken over all items by Spark. The index goes to the tasks in
shards of bounded size, one pass over the documents for each; more items give more
passes, not a larger broadcast.

Rows: null text counts as empty, items without words match nothing, null ids stay,
repeated documents each get their rows, repeated items (id and text) count once. No
items or no documents give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landcompare.llm.common import few, frugal, packed, stored, table, texts
from landcompare.llm.toxicity import pieces

K1, B = 1.2, 0.75
THRESHOLD = 0.6  # of the score that an item's own text gets
SHINGLE, OVERLAP = 5, 0.8
BLOCK_ITEMS = 8
PASSAGES = 512  # of a long text at a time
SHARD_POSTINGS = 100_000  # distinct words of items, counted per item, in one broadcast

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?\n])\s+(?=\S)")
FOUND = "item BIGINT, passage BIGINT, score DOUBLE, question_overlap DOUBLE, answer_overlap DOUBLE, overlap DOUBLE"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """(question, answer): the words up to the last sentence, and those of it; one sentence is both."""
    sentences = [w for w in map(words_of, SENTENCE.split(text)) if w]
    if len(sentences) < 2:
        return words_of(text), words_of(text)
    return [w for s in sentences[:-1] for w in s], sentences[-1]


# Weights over all items


def postings_of(items: DataFrame) -> DataFrame:
    """(item, word, weight, length) with the weights of an item summing to 1."""

    def run(batches):
        for batch in batches:
            rows = [(i, w, n, len(ws)) for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True) for ws in [words_of(t)] for w, n in _counts(ws)]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item", "word", "n", "length"])

    counts = items.mapInArrow(run, "item BIGINT, word STRING, n BIGINT, length BIGINT")
    counts = stored(counts, "bm25-counts")
    whole = counts.groupBy("item").agg(F.first("length").alias("length")).agg(F.count("*").alias("items"), F.avg("length").alias("mean")).first()
    n_items, mean = F.lit(whole["items"]), F.lit(whole["mean"] or 1.0)
    df = counts.groupBy("word").agg(F.count("*").alias("df"))
    rows = counts.join(df, "word")
    idf = F.log(1 + (n_items - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") / mean))
    rows = rows.select("item", "word", "length", weight.alias("raw"))
    total = rows.groupBy("item").agg(F.sum("raw").alias("total"))
    return rows.join(total, "item").select("item", "word", (F.col("raw") / F.col("total")).alias("weight"), "length")


def _counts(words: list[str]) -> list[tuple[str, int]]:
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return list(counts.items())


# Index of one shard


class Index:
    """Postings by word with block maxima, and the items' runs of words for the check."""

    def __init__(self, items: list[int], found: list[str], postings: list[tuple[int, str, float]]):
        self.items = items
        at = {item: k for k, item in enumerate(items)}
        self.words = {w: k for k, w in enumerate(dict.fromkeys(w for _, w, _ in postings))}
        rows = np.array([self.words[w] for _, w, _ in postings], np.int64)
        owners = np.array([at[i] for i, _, _ in postings], np.int64)
        weights = np.array([x for _, _, x in postings])
        order = np.lexsort((owners, rows))
        rows, self.owners, self.weights = rows[order], owners[order], weights[order]
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        self.places = rows * self.blocks + self.owners // BLOCK_ITEMS  # of postings by word and block, ascending
        self.bounds = np.zeros((len(self.words), self.blocks), np.float32)
        np.maximum.at(self.bounds, (rows, self.owners // BLOCK_ITEMS), self.weights)
        parts = [parts_of(t) for t in found]
        self.parts = [tuple(self._runs(p) for p in (q, a, words_of(t))) for (q, a), t in zip(parts, found, strict=True)]
        self.longest = max((len(words_of(t)) for t in found), default=1)

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.words.get
        return np.array([get(w, -1) for w in words], np.int32)

    def _runs(self, words: list[str]) -> frozenset[tuple[int, ...]]:
        ids, n = self.ids(words).tolist(), min(SHINGLE, len(words))
        return frozenset(tuple(ids[k : k + n]) for k in range(len(ids) - n + 1)) if ids else frozenset()

    def search(self, ids: np.ndarray) -> dict[int, tuple]:
        """Per item the best verified passage of a text: (overlap, score, -first word, question's and answer's share)."""
        best: dict[int, tuple] = {}
        step = self.longest * PASSAGES
        for start in range(0, len(ids), step):
            self._search(ids[start : start + step + self.longest], start, best)
        return best

    def _search(self, ids: np.ndarray, start: int, best: dict[int, tuple]) -> None:
        size, known = self.longest, np.flatnonzero(ids >= 0)
        if not len(known):
            return
        # Distinct words by passage; a word lies in the passage that starts at its stretch and in the one before.
        stretch, wide = known // size, len(self.words)
        at = np.unique(np.concatenate([stretch * wide + ids[known], ((stretch - 1) * wide + ids[known])[stretch > 0]]))
        passage, word = at // wide, at % wide
        first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        bounds = np.add.reduceat(self.bounds[word], first, axis=0)
        row, block = np.nonzero(bounds >= THRESHOLD - 1e-4)
        if not len(row):
            return
        # The postings that the passages' words have in the blocks to be opened.
        sizes = np.diff(np.append(first, len(word)))
        pair, offset = _ranges(first[row], sizes[row])
        words, blocks = word[offset], block[pair]
        held = self.bounds[words, blocks] > 0
        pair, place = pair[held], words[held] * self.blocks + blocks[held]
        low, high = np.searchsorted(self.places, place, "left"), np.searchsorted(self.places, place, "right")
        of, posting = _ranges(low, high - low)
        scores = np.bincount(pair[of] * BLOCK_ITEMS + self.owners[posting] % BLOCK_ITEMS, self.weights[posting], len(row) * BLOCK_ITEMS)
        for hit in np.flatnonzero(scores >= THRESHOLD).tolist():
            k, item = int(passage[first[row[hit // BLOCK_ITEMS]]]), int(block[hit // BLOCK_ITEMS]) * BLOCK_ITEMS + hit % BLOCK_ITEMS
            self._verify(item, ids[k * size : (k + 2) * size].tolist(), float(scores[hit]), start + k * size, best)

    def _verify(self, item: int, passage: list[int], score: float, first: int, best: dict[int, tuple]) -> None:
        runs: dict[int, set] = {}
        question, answer, both = (self._share(part, passage, runs) for part in self.parts[item])
        row = (both, score, -first, question, answer)
        if both >= OVERLAP and row > best.get(item, (0.0,)):
            best[item] = row

    @staticmethod
    def _share(part: frozenset, ids: list[int], runs: dict[int, set]) -> float:
        if not part:
            return 0.0
        n = len(next(iter(part)))
        if n not in runs:
            runs[n] = set(zip(*(ids[k:] for k in range(n)), strict=False))
        return len(part & runs[n]) / len(part)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and which number, of all numbers in the ranges."""
    which = np.repeat(np.arange(len(starts)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which]


def _search(texts_of_batch: list[str], index: Index) -> list[list[tuple]]:
    rows = []
    for text in texts_of_batch:
        ids = [index.ids(WORD.findall(p)) for p in pieces(text.lower())]
        best = index.search(np.concatenate(ids) if ids else np.zeros(0, np.int32))
        rows.append([(index.items[i], -at, s, q, a, o) for i, (o, s, at, q, a) in sorted(best.items())])
    return rows


# Operators


def shards(items: DataFrame) -> tuple[DataFrame, Iterator[tuple]]:
    """The numbered items, and what the index of each shard is built of, one shard at a time."""
    rows = items.select(F.col("item_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    rows = stored(rows.withColumn("item", F.xxhash64("item_id", F.sha2("text", 256))), "bm25-items")
    postings = stored(postings_of(rows.select("item", "text")), "bm25-postings")
    count = max(1, -(-postings.count() // SHARD_POSTINGS))
    here = F.pmod(F.xxhash64("item", F.lit(1)), F.lit(count))

    def parts():
        for k in range(count):
            own = postings.where(here == k).select("item", "word", "weight").toPandas()
            found = rows.where(here == k).select("item", "text").toPandas()
            found = found[found["item"].isin(own["item"])].sort_values("item")
            if len(found):
                yield found["item"].tolist(), found["text"].tolist(), list(own.itertuples(index=False, name=None))

    return rows, parts()


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, passage, score, question_overlap, answer_overlap, overlap): a row per document and item it holds.

    ``passage`` is the first word's number of the passage with the largest overlap.
    """
    spark = docs.sparkSession
    rows, parts = shards(items)
    source, found = texts(docs), []
    for part in parts:
        found.append(source.mapInArrow(_leaks_of(spark.sparkContext.broadcast(part)), f"doc_id BIGINT, {FOUND}"))
    if not found:
        return spark.createDataFrame([], "doc_id BIGINT, item_id BIGINT, " + FOUND.removeprefix("item BIGINT, "))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.join(rows.select("item", "item_id"), "item").select("doc_id", "item_id", *(c for c in whole.columns if c not in ("doc_id", "item")))


def _leaks_of(shared):
    def run(batches):
        index = None
        for batch in few(batches):
            index = index or Index(*shared.value)
            rows = _search(batch.column("text").to_pylist(), index)
            ids = pa.array(np.repeat(np.arange(len(rows)), list(map(len, rows))))
            flat = list(zip(*(x for row in rows for x in row), strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
            columns = [batch.column("doc_id").take(ids), *(pa.array(c, t) for c, t in zip(flat, types, strict=True))]
            yield pa.record_batch(columns, ["doc_id", "item", "passage", "score", "question_overlap", "answer_overlap", "overlap"])

    return frugal(run)


def drop_leaking(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item; a pass over them per shard of the index, no shuffle."""
    rows = packed(docs).select("row")
    for part in shards(items)[1]:
        rows = rows.mapInArrow(_clean_of(docs.sparkSession.sparkContext.broadcast(part)), rows.schema)
    return rows.select("row.*")


def _clean_of(shared):
    def run(batches):
        index = None
        for batch in few(batches):
            index = index or Index(*shared.value)
            found = [t or "" for t in batch.column("row").field("text").to_pylist()]
            yield batch.filter(pa.array([not row for row in _search(found, index)], pa.bool_()))

    return frugal(run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
