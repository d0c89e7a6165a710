"""Spelling variants of words through an index of variable-length grams.

Words near each other differ by one code point. The gram dictionary is pruned by frequency:
a gram stays as short as it is rare; one that more than a share of the words holds is
extended by the next letter, up to ``min_length - 3`` letters. A word decomposes into the
gram that begins at each of its positions. Where a gram ends depends on nothing behind it
but the word's end, so one edit affects only the grams over the edited place: the most that
any place has over it is the word's affected-gram bound, and near words share all grams
but so many, at the same positions, or one apart behind an inserted letter.

So among a word's (bound + 1) rarest grams one is shared with each near word, within that
one's own (bound + 1) rarest: only those are indexed, by gram, position and length. The lists are merged
in tasks: shared positional grams of a pair are tallied, pairs that reach the larger of both
words' minimum are verified letter by letter, and a pair counts under the smallest of its
shared keys only. No pair leaves its task that isn't near. Lists can only be long where a
gram is frequent; those are counted, and lists over ``LIST`` words are dealt in blocks,
compared two at a time.

Rows: null text has no words, a null doc_id counts as empty in the hash of the noise, repeated
rows count each time. An empty table gives an empty result. Other columns are ignored, whatever
their names. Letters are those below U+0100, so a word has a byte per letter here.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landcompare.llm.common import mixed, stored, table, texts
from landcompare.llm.simhash import whole_runs

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
NOISE = 31  # one in so many runs of a document loses a letter
SHORTEST = 2  # letters of a gram
SHARE = 4096  # a gram is frequent if it occurs more often than a word in so many: the dictionary keeps some 10 * SHARE for each length
LIST, LISTS = 4096, 1000  # words of a list compared at once: so many, or one in so many of all words
FEW, TILE = 12, 512  # rows of a run whose pairs are listed; rows tallied together in a longer one
HELD = 100_000  # words counted in a task before they are handed on


# Words


def words_of(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, with their reproducible noise, of enough letters and occurrences."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_length},}}")  # shorter runs only get shorter

    def batch_of(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % NOISE == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield batch_of(held)
                    held.clear()
        if held:
            yield batch_of(held)

    counts = texts(docs).mapInArrow(count, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


def by_length(words: list[str]):
    """(length, places, letters as a matrix of bytes) of each length among the words."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        data = "".join([words[k] for k in at.tolist()]).encode("latin-1")
        yield length, at, np.frombuffer(data, np.uint8).reshape(len(at), length)


# Dictionary and decomposition


def packed_grams(letters: np.ndarray, q: int) -> np.ndarray:
    """Every run of q letters as one number that tells its length too."""
    n = letters.shape[1] - q + 1
    found = np.ones((len(letters), max(n, 0)), np.int64)
    for k in range(q):
        found = found << 8 | letters[:, k : k + n]
    return found


def frequent_grams(words: DataFrame, longest: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams that occur more than ``least`` times, sorted, and how often; at most (letters of all words) / least for each length."""

    def count(batches):
        for batch in batches:
            for _, _, letters in by_length(batch.column("word").to_pylist()):
                for q in range(SHORTEST, longest + 1):
                    grams, n = np.unique(packed_grams(letters, q), return_counts=True)
                    yield pa.record_batch([pa.array(grams), pa.array(n.astype(np.int64))], ["gram", "n"])

    counts = words.select("word").mapInArrow(count, "gram BIGINT, n BIGINT").groupBy("gram").agg(F.sum("n").alias("n"))
    found = sorted(tuple(r) for r in counts.where(F.col("n") > least).collect())
    grams, n = (np.array([r[k] for r in found], np.int64) for k in (0, 1))
    return grams, n


class Decomposition:
    """Words of one length: the gram at each position, how frequent it is, and the affected-gram bounds."""

    def __init__(self, letters: np.ndarray, grams: np.ndarray, counts: np.ndarray, longest: int) -> None:
        size, length = letters.shape
        positions = length - SHORTEST + 1
        self.grams = packed_grams(letters, SHORTEST)
        self.counts = lookup(self.grams, grams, counts)
        sizes = np.full((size, positions), SHORTEST)
        longer = self.counts > 0
        for q in range(SHORTEST, longest):
            room = max(0, length - q)
            longer = longer & (np.arange(positions) < room)
            extended = self.grams.copy()
            extended[:, :room] = self.grams[:, :room] << 8 | letters[:, q : q + room]
            self.grams = np.where(longer, extended, self.grams)
            sizes += longer
            self.counts = np.where(longer, lookup(extended, grams, counts), self.counts)
            longer = longer & (self.counts > 0)
        over = np.zeros((size, length), np.int64)
        for d in range(longest):
            wide = min(positions, length - d)
            over[:, d : d + wide] += sizes[:, :wide] > d
        self.bound = over.max(1)
        self.least = positions - self.bound  # grams that a near word shares at least
        order = np.argsort(self.counts << 40 | self.grams, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(positions)[None, :], axis=1)
        self.indexed = rank <= self.bound[:, None]
        self.length = length

    def keys(self, length: int) -> np.ndarray:
        """Keys of the lists for words of ``length`` and one letter more; -1 where there is none or it is repeated."""
        at = np.arange(self.grams.shape[1])
        found = [_keys(self.grams, at, length)]
        indexed = [self.indexed]
        if length < self.length:  # behind an inserted letter
            found.append(_keys(self.grams, at - 1, length))
            indexed.append(self.indexed & (at > 0))
        keys = np.where(np.concatenate(indexed, axis=1), np.concatenate(found, axis=1), -1)
        keys.sort(axis=1)
        keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
        return keys


def _keys(grams: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    place = (at.astype(np.uint64) << np.uint64(48)) ^ np.uint64(length << 56 & (1 << 64) - 1)
    return (mixed(grams.astype(np.uint64) ^ place) >> np.uint64(1)).astype(np.int64)


def lookup(x: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each gram occurs if it is frequent, else 0."""
    if not len(grams):
        return np.zeros(x.shape, np.int64)
    at = np.minimum(np.searchsorted(grams, x), len(grams) - 1)
    return np.where(grams[at] == x, counts[at], 0)


def postings(words: DataFrame, dictionary, longest: int, min_length: int) -> DataFrame:
    """(key, long, frequent, word, n): a row per word and list; ``long`` marks words of one letter more than the list's."""
    names = ["key", "long", "frequent", "word", "n"]

    def run(batches):
        grams, counts = dictionary.value
        for batch in batches:
            found = batch.column("word").to_pylist()
            for length, at, letters in by_length(found):
                parts = Decomposition(letters, grams, counts, longest)
                frequent = (parts.indexed & (parts.counts > 0)).any(1)
                for of in (length, length - 1):
                    if of >= min_length:
                        keys = parts.keys(of)
                        row, column = np.nonzero(keys >= 0)
                        rows = pa.array(at[row])
                        flags = [pa.array(np.full(len(row), of < length)), pa.array(frequent[row])]
                        yield pa.record_batch([pa.array(keys[row, column]), *flags, batch.column("word").take(rows), batch.column("n").take(rows)], names)

    return words.mapInArrow(run, "key BIGINT, long BOOLEAN, frequent BOOLEAN, word STRING, n BIGINT")


# Merging lists


class Rows:
    """Rows of lists as matrices: letters, grams by position, keys."""

    def __init__(self, words: list[str], long: np.ndarray, dictionary, longest: int) -> None:
        grams, counts = dictionary
        size, width = len(words), max(map(len, words)) + 1
        self.long = long
        self.letters = np.zeros((size, width), np.uint8)
        # 32 bits of each gram; no gram is 1, 2 or 3.
        self.grams = np.ones((size, width), np.uint32)
        self.least = np.zeros(size, np.int64)
        self.keys = np.full((size, 2 * width), -1, np.int64)
        for length, at, letters in by_length(words):
            parts = Decomposition(letters, grams, counts, longest)
            self.letters[at, :length] = letters
            self.grams[at, : parts.grams.shape[1]] = (mixed(parts.grams.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(4)
            self.least[at] = parts.least
            for which, of in ((~long[at], length), (long[at], length - 1)):
                if which.any():
                    keys = parts.keys(of)[which]
                    self.keys[at[which], : keys.shape[1]] = keys
        # A long word's grams one place on; other words have none.
        self.moved = np.full((size, width), 2, np.uint32)
        self.moved[long, :-1] = self.grams[long, 1:]
        short = np.arange(width) >= np.fromiter(map(len, words), np.int64, size)[:, None] - SHORTEST + 1
        self.grams_short = np.where(short, np.uint32(3), self.grams)  # a short word's padding equals nothing
        self.lengths = np.fromiter(map(len, words), np.int64, size) - SHORTEST + 1
        self.by_position = np.ascontiguousarray(self.grams.T)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs that reached the count: those one letter apart, a being no longer than b."""
        x, y = self.letters[a], self.letters[b]
        replaced = (x != y).sum(1) == 1
        front = np.cumprod(x == y, axis=1).sum(1)
        back = np.cumprod((x[:, :-1] == y[:, 1:])[:, ::-1], axis=1).sum(1)
        return np.where(self.long[b], front + back >= x.shape[1] - 1, replaced)

    def first_key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The smallest key that both words of a pair have in lists of their kind."""
        found = np.full(len(a), np.iinfo(np.int64).max)
        for k in range(self.keys.shape[1]):
            key = self.keys[a, k]
            both = (key >= 0) & (key[:, None] == self.keys[b]).any(1)
            found = np.where(both, np.minimum(found, key), found)
        return found

    def merge(self, key: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Near pairs of the rows of each run, short words first, each under its first key; where a run isn't of ``one`` block, from different blocks."""
        run = np.repeat(np.arange(len(starts)), ends - starts)
        few = np.repeat(ends - starts <= FEW, ends - starts)
        found: list[np.ndarray] = []
        for d in range(1, FEW):
            at = np.flatnonzero((run[d:] == run[:-d]) & few[d:] & ~self.long[:-d] & (one[d:] | (block[d:] != block[:-d])))
            if not len(at):
                break
            shared = ((self.grams_short[at] == self.grams[at + d]) | (self.grams_short[at] == self.moved[at + d])).sum(1)
            at = at[shared >= np.maximum(self.least[at], self.least[at + d])]
            found.append(np.stack([at, at + d]))
        for k in np.flatnonzero(ends - starts > FEW).tolist():
            found += self._tiles(int(starts[k]), int(ends[k]), block, bool(one[starts[k]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.concatenate(found, axis=1)
        keep = self.near(a, b)
        a, b = a[keep], b[keep]
        keep = self.first_key(a, b) == key[a]
        return a[keep], b[keep]

    def _tiles(self, start: int, end: int, block: np.ndarray, one: bool) -> list[np.ndarray]:
        """The pairs of a long run that reach the count, tallied position by position."""
        short = end - int(self.long[start:end].sum())  # long words come last
        positions = int(self.lengths[start])
        found = []
        for low in range(start, short, TILE):
            a = slice(low, min(low + TILE, short))
            for begin, stop, moved in ((low, short, False), (short, end, True)):
                for left in range(begin, stop, TILE):
                    b = slice(left, min(left + TILE, stop))
                    shared = np.zeros((a.stop - a.start, b.stop - b.start), np.uint8)
                    for p in range(positions):
                        mine = self.by_position[p, a][:, None]
                        same = mine == self.by_position[p, b]
                        if moved:
                            same |= mine == self.by_position[p + 1, b]
                        shared += same
                    reached = shared >= np.maximum(self.least[a][:, None], self.least[b][None, :])
                    if left == low and not moved:
                        reached = np.triu(reached, 1)
                    if not one:
                        reached &= block[a][:, None] != block[b][None, :]
                    x, y = np.nonzero(reached)
                    if len(x):
                        found.append(np.stack([x + low, y + left]))
        return found


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, share: int = SHARE, list_size: int = LIST) -> DataFrame:
    """(word, near, n): both directions of every pair of near words, n being that of ``near``."""
    spark, longest = words.sparkSession, min_length - 3
    total = words.count()
    dictionary = spark.sparkContext.broadcast(frequent_grams(words, longest, max(1, total // share)))
    listed = postings(words, dictionary, longest, min_length)
    # At most 15 * LISTS lists are longer: a word is in 3 * (longest + 1) of them.
    most = max(list_size, total // LISTS)
    heavy = listed.where("frequent").groupBy("key").agg(F.ceil(F.count("*") / most).alias("blocks")).where("blocks > 1")
    dealt = listed.drop("frequent").join(F.broadcast(heavy), "key", "left")
    blocks = F.coalesce("blocks", F.lit(1).cast("bigint"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    pair = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    dealt = dealt.select("key", *pair, "block", "long", "word", "n").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "long")

    def run(batches):
        for columns in whole_runs(batches):
            new = np.append(True, np.any([columns[c][1:] != columns[c][:-1] for c in ("key", "i", "j")], axis=0))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(new)))
            at = np.flatnonzero(np.repeat(sizes > 1, sizes))
            if len(at):
                part = {name: x[at] for name, x in columns.items()}
                rows = Rows(part["word"].tolist(), part["long"].astype(bool), dictionary.value, longest)
                ends = np.cumsum(sizes[sizes > 1])
                a, b = rows.merge(part["key"], ends - sizes[sizes > 1], ends, part["block"], part["i"] == part["j"])
                a, b = np.concatenate([a, b]), np.concatenate([b, a])
                word = part["word"]
                yield pa.record_batch([pa.array(word[a], pa.string()), pa.array(word[b], pa.string()), pa.array(part["n"][b])], ["word", "near", "n"])

    return dealt.mapInArrow(run, "word STRING, near STRING, n BIGINT")


# Operator


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its near words, the most frequent of them if ``ratio`` times as frequent, and where forms lead."""
    words = stored(words_of(docs, min_length, min_count), "spelling-words")
    best = near_words(words, min_length).groupBy("word")
    best = best.agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    formed = -F.col("best.less") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word",
        F.when(formed, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(formed, -F.col("best.less")).alias("form_n"),
    )
    found = stored(found, "spelling-forms")
    roots = roots_of(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, root) by pointer doubling: a form is ``RATIO`` times as frequent as its word, so chains are short."""
    forms, going = stored(forms, "spelling-roots"), True
    while going:
        after = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = forms.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = stored(moved, "spelling-roots")
        going, forms = bool(moved.where("moved").take(1)), moved.drop("moved")
    return forms


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2),
      lambda k: ('0x' || h[2 * k + 1 : 2 * k + 2])::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM (SELECT run, n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS h FROM runs), crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), holes AS (
  SELECT word, n, k, word[: k - 1] AS front, word[k + 1 :] AS back FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.k = b.k AND a.front = b.front AND a.back = b.back AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.front || a.back = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.front || a.back = b.word
), best AS (
  SELECT word, count(*) AS n_near, min({'less': -n, 'other': other}) AS best FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.best.less >= 10 * w.n THEN b.best.other END AS form,
    CASE WHEN -b.best.less >= 10 * w.n THEN -b.best.less END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), roots AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT r.word, r.next, f.form FROM roots r JOIN forms f ON f.word = r.next
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM roots WHERE next IS NULL) USING (word)
"""
