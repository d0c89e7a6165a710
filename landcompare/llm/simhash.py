"""SimHash near-duplicates through an inverted index of byte positions.

A fingerprint is cut into bytes. Fingerprints at most k bits apart differ in at most
k bytes, so of B positional bytes they share at least B - k: that is the count filter.
Posting lists of single bytes would each hold a 256th of the corpus, so the index is
keyed by three bytes with their positions. The positions fall into parts, and the
triples (``triples``) are chosen so that every set of positions as large as the
guaranteed minimum holds one of them: no pair at that count is missed. Pairs that meet
in a list have their shared positional bytes tallied, those at the minimum are
verified by their differing bits.

No list is taken whole. Lists are dealt in blocks of hashed members, and a task sees
two blocks at most. It returns a spanning forest of the links it finds, nearest first,
in place of all pairs, so a group of n near copies gives a multiple of n rows, and
connected components come out as they would from all links.

Rows: null text counts as empty, null ids are kept but never chosen as a
representative where a group has another; repeated rows get the same result; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landcompare.llm.common import digest, few, frugal, packed, stored, table, texts
from landcompare.operators.components import connected_components

SHINGLE, MAX_BITS = 4, 4
BLOCK = 512  # members of a posting list that one task compares with as many others

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPACE = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20
FAR = 255
BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


# Fingerprints


def words_of(data: bytes, more: int = 0) -> Iterator[list[bytes]]:
    """The words of a text in lists of about a megabyte, each preceded by the last ``more`` words before it."""
    at, kept = 0, []
    while at < len(data):
        end = SPACE.search(data, at + PIECE)
        end = end.start() if end else len(data)
        found = kept + WORD.findall(data, at, end)
        yield found
        at, kept = end, found[-more:] if more else []


def shingle_hashes(data: bytes, n: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of n words joined by a blank, or of all words if they are fewer; in pieces."""
    xxh64, few, some = xxhash.xxh64_intdigest, None, False
    for words in words_of(data, n - 1):
        if len(words) < n:
            few = words  # the whole text, unless there was a shingle before
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends[: len(words) - n + 1] - np.fromiter(map(len, words[: len(words) - n + 1]), np.int64) - 1).tolist()
        found = [xxh64(line[a:b], 42) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)]
        some = True
        yield np.array(found, np.uint64)
    if few and not some:
        yield np.array([xxh64(b" ".join(few), 42)], np.uint64)


def majority(pieces: Iterator[np.ndarray], width: int) -> bytes:
    """The bits set in over half of all rows of ``width`` bytes; zeros if there is no row."""
    tally, rows = np.zeros((width, 256), np.int64), 0
    offsets = np.arange(width) * 256
    for piece in pieces:
        rows += len(piece)
        tally += np.bincount((piece + offsets).ravel(), minlength=width * 256).reshape(width, 256)
    return np.packbits((tally @ BITS_OF * 2 > rows).ravel()).tobytes()


def big_endian(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)


def simhash(text: str, n: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    data = text.encode().lower()
    return int.from_bytes(majority(map(big_endian, shingle_hashes(data, n)), 8), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key BINARY, fingerprint BIGINT) of every row; the key stands for id and text."""

    def run(batches):
        for batch in few(batches):
            found = pa.array([simhash(t, shingle) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), found], ["doc_id", "key", "fingerprint"])

    return texts(docs).withColumn("key", _key_of_row()).mapInArrow(frugal(run), "doc_id BIGINT, key BINARY, fingerprint BIGINT")


# Index


def triples(parts: list[list[int]]) -> list[tuple[int, ...]]:
    """Triples of positions within a part, and of two in a part with one of the next.

    With three parts of eight positions every four positions hold one of them.
    """
    found = [t for part in parts for t in combinations(part, 3)]
    following = parts[1:] + parts[:1]
    return found + [(*two, one) for part, after in zip(parts, following, strict=True) for two in combinations(part, 2) for one in after]


# Every set of as many positions as the minimum holds one of the triples (tests try them all).
OF_8, SHARED_OF_8 = triples([[0, 1, 2], [3, 4, 5], [6, 7]]), 4


def _byte(numbers: list[str], position: int) -> Column:
    return F.shiftrightunsigned(F.col(numbers[position // 8]), 8 * (7 - position % 8)).bitwiseAND(F.lit(255))


def _key(numbers: list[str], which: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(which).cast("bigint")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(numbers, p))
    return key


def members(prints: DataFrame, node: str, numbers: list[str], chosen: list[tuple[int, ...]], block: int) -> DataFrame:
    """The posting lists that have two members or more, dealt in blocks: (key, i, j, block, all columns of ``prints``)."""
    keys = F.explode(F.array(*[_key(numbers, k, p) for k, p in enumerate(chosen)]))
    postings = prints.select(keys.alias("key"), "*")
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block)
    listed = postings.join(sizes, "key").withColumn("blocks", blocks)
    listed = listed.withColumn("block", F.pmod(F.xxhash64(node), "blocks")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    pair = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    return listed.select("key", *pair, "block", *prints.columns)


def forests(listed: DataFrame, node: str, distance, limit: int) -> DataFrame:
    """(a, b): a spanning forest, nearest first, of the pairs of a run (key, i, j) within ``limit``.

    ``distance(columns, rows, others)`` gives a matrix of numbers up to 255.
    """

    def run(batches):
        for columns in whole_runs(batches):
            starts = np.flatnonzero(_changes(columns))
            ends = np.append(starts[1:], len(columns["key"]))
            a, b = [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > 1:
                    part = {name: x[s:e] for name, x in columns.items()}
                    for x, y in spanning(_distances(part, distance), limit):
                        a.append(part[node][x])
                        b.append(part[node][y])
            if a:
                yield pa.record_batch([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], ["a", "b"])

    dealt = listed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(frugal(run), "a BIGINT, b BIGINT").where("a <> b")


def _changes(columns: dict[str, np.ndarray]) -> np.ndarray:
    new = np.ones(len(columns["key"]), bool)
    new[1:] = False
    for name in ("key", "i", "j"):
        new[1:] |= columns[name][1:] != columns[name][:-1]
    return new


def whole_runs(batches) -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches as numpy columns, cut so that no run is split; what is held back is a run of two blocks."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if batch.num_rows:
            new = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
            held = new if held is None else {name: np.concatenate([held[name], new[name]]) for name in new}
            last = int(np.flatnonzero(_changes(held))[-1])
            if last:
                yield {name: x[:last] for name, x in held.items()}
                held = {name: x[last:] for name, x in held.items()}
    if held is not None:
        yield held


def _distances(part: dict[str, np.ndarray], distance) -> np.ndarray:
    found = distance(part)
    if part["i"][0] != part["j"][0]:  # pairs within a block belong to another run
        found[part["block"][:, None] == part["block"][None, :]] = FAR
    return found


def spanning(distances: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Prim's forest over pairs within the limit."""
    n = len(distances)
    best, parent = np.full(n, FAR + 1, np.int64), np.zeros(n, np.int64)
    todo = np.ones(n, bool)
    for _ in range(n):
        at = int(np.where(todo, best, FAR + 2).argmin())
        if best[at] <= limit:
            yield int(parent[at]), at
        todo[at] = False
        nearer = distances[at] < best
        best[nearer], parent[nearer] = distances[at][nearer], at


def tallied(numbers: list[str], shared: int, bits: int):
    """Differing bits of pairs that share enough positional bytes and differ in few enough bits; else 255."""

    def distance(part: dict[str, np.ndarray]) -> np.ndarray:
        size = len(part[numbers[0]])
        count, differing = np.zeros((size, size), np.int64), np.zeros((size, size), np.int64)
        for name in numbers:
            x = part[name].view(np.uint64)
            apart = x[:, None] ^ x[None, :]
            count += (apart.view(np.uint8).reshape(size, size, 8) == 0).sum(2)
            differing += np.bitwise_count(apart)
        differing[(count < shared) | (differing > bits)] = FAR
        return differing

    return distance


# Operator


def groups_of(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(fingerprint, component) of every distinct fingerprint that is linked at ``max_bits`` (4 at most) differing bits or fewer."""
    if max_bits > 8 - SHARED_OF_8:
        raise ValueError("the index holds pairs of 4 differing bits or fewer")
    nodes = stored(prints.select("fingerprint").distinct(), "simhash-nodes")
    listed = members(nodes, "fingerprint", ["fingerprint"], OF_8, block)
    links = forests(listed, "fingerprint", tallied(["fingerprint"], 8 - max_bits, max_bits), max_bits)
    return connected_components(links).withColumnRenamed("node", "fingerprint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint 16 hex digits, component_id) of every row.

    Fingerprints of runs of ``shingle`` words link at ``max_bits`` (4 at most) differing bits or fewer;
    a component's id is its smallest doc_id that isn't null. Texts without words share the fingerprint zero.
    """
    prints = stored(fingerprints(docs, shingle).drop("key"), "simhash")
    groups = groups_of(prints, max_bits, block)
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    named = nodes.join(groups, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(ids, "component").select("fingerprint", "component_id")
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return prints.join(named, "fingerprint").select("doc_id", hexed, "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# Pipeline stage


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, one of each group that ``near_duplicates`` finds with the same shingles and bits.

    Of a group the row with the smallest doc_id stays (nulls last, then the smallest digest). Texts without
    words form one group. Rows repeated with doc_id and text stay once.
    """
    prints = stored(fingerprints(docs, shingle), "simhash-stage")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    heads = prints.groupBy("fingerprint").agg(F.min(order).alias("head"))
    kept = heads.join(groups_of(prints, max_bits, block), "fingerprint", "left")
    kept = kept.groupBy(F.coalesce("component", "fingerprint").alias("component")).agg(F.min("head").alias("head"))
    stay = packed(docs).select("row", _key_of_row().alias("key")).join(kept.select(F.col("head.key").alias("key")), "key")
    return stay.dropDuplicates(["key"]).select("row.*")


def _key_of_row() -> Column:
    """32 bytes for a row's id and text."""
    return digest(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
