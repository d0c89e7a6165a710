"""Jaccard join of documents on word shingles through PartEnum signatures.

A document is its set of distinct shingles. Two sets link if their Jaccard similarity is
at least ``percent`` / 100, that is, if they differ in at most
(100 - percent) * (n + m) / (100 + percent) elements.

Signatures. Sizes fall into bands whose ends are ``percent`` apart, so sets that link lie
in one band or in neighbouring ones; a set has signatures for its own band and the next.
A band's largest difference is k. The domain of hashed shingles is cut into parts, more
than k / 2 of them, so that some part of two linked sets holds one differing element at
most; each part is cut into three cells, and one signature stands for each two of them:
linked sets share one. A signature of cells that hold no element says nothing, and would
be shared by all who have it; it is given only where a set has so many such parts that a
link could rest on them alone (``SPARE`` parts more than needed make that rare).

Search. Sets of one content count once. A list holds the sets that share a signature.
First every member is compared with the list's smallest. Lists that still hold several
components make families of sets, and all members of a family that are in different components
are compared, in blocks of a bounded size. There a sketch comes first: the parity of the
elements under a hash into some bits differs in at most as many bits as the sets have differing
elements, so it rejects no link. Both comparisons end in the exact intersection. A pair within
a component is skipped, as it can't change the result: no link between different texts is lost.

A third of all rows may have one text: a task gives the signatures of a set once, and
streams through a sorted list, holding two rows of it.

Rows: null text counts as empty; sets without elements link with nothing and are their own
component (doc_id null if that is null). Null ids stay and name a component only where it
has no other. Repeated rows get the same result. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landcompare.llm.common import GOLDEN, mixed, small_batches, stored, table, texts
from landcompare.operators.components import connected_components
from landcompare.llm.simhash import whole_runs, words_of

SHINGLE, PERCENT = 3, 90
CELLS = 3  # of a part; each two of them make a signature
SPARE, FEW = 1, 6  # parts more than needed, where k is no smaller than FEW
BLOCK, BLOCK_ELEMENTS = 512, 1 << 20  # sets, and their elements, that a task compares with as many others
SKETCH_SHARE = 0.5  # bits per element, at least; a power of two

def shingle_set(text: str, n: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles, A-Z lower-cased; each word is hashed once, a shingle from its words."""
    found, few = [], None
    for words in words_of(text.encode().lower(), n - 1):
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        if len(words) >= n:
            found.append(_chained([hashes[k : len(words) - n + 1 + k] for k in range(n)]))
        else:
            few = hashes
    if not found and few is not None and len(few):
        found.append(_chained([few[k : k + 1] for k in range(len(few))]))
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.sort(np.concatenate(found))
    return hashes[np.append(True, hashes[1:] != hashes[:-1])]


def _chained(columns: list[np.ndarray]) -> np.ndarray:
    found = np.full(len(columns[0]), len(columns), np.uint64)
    for column in columns:
        found = mixed((found ^ column) + GOLDEN)
    return found


def bands(percent: int, largest: int) -> list[tuple[int, int]]:
    """(smallest, largest size) of every band up to one that holds ``largest``."""
    found, low = [], 1
    while not found or found[-1][1] < largest:
        high = low * 100 // percent
        found.append((low, high))
        low = high + 1
    return found


def differing(sizes: int, percent: int) -> int:
    """The most elements in which two linked sets of these sizes together may differ."""
    return (100 - percent) * sizes // (100 + percent)


def signatures(elements: np.ndarray, running: np.ndarray, band: int, k: int) -> np.ndarray:
    """The signatures of a sorted set, with the running sums of its mixed elements, in a band whose linked sets differ in k elements at most."""
    spare = SPARE if k >= FEW else 0
    parts = k // 2 + 1 + spare
    cells = parts * CELLS
    # The elements are hashes in order, so a cell is a range of them.
    cell = ((elements >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
    held = np.bincount(cell.astype(np.int64), minlength=cells)
    ends = np.cumsum(held)
    sums = (running[ends] - running[ends - held]).reshape(parts, CELLS)
    held = held.reshape(parts, CELLS)
    names = np.arange(cells, dtype=np.uint64).reshape(parts, CELLS) + (np.uint64(band) << np.uint64(40))
    found = mixed(sums.sum(1, keepdims=True) - sums + mixed(names + GOLDEN))
    void = held.sum(1, keepdims=True) == held
    if void.any(1).sum() <= spare:  # some part that holds a link has no empty signature
        found = found[~void]
    return found.ravel()


def both_signatures(elements: np.ndarray, of: int, limits: list[tuple[int, int]], percent: int) -> np.ndarray:
    """For the set's own band and the next larger one."""
    running = np.append(np.uint64(0), np.cumsum(mixed(elements + GOLDEN)))
    return np.concatenate([signatures(elements, running, b, differing(2 * limits[b][1], percent)) for b in (of, of + 1)])


def sketch(elements: np.ndarray) -> bytes:
    """The parity of the elements in each of some bits: half as many bits or more than elements, at least 64."""
    bits = max(64, 1 << int(np.ceil(np.log2(max(1, SKETCH_SHARE * len(elements))))))
    at = (mixed(elements) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(data: np.ndarray, words: int) -> np.ndarray:
    """Sketches, a row each, under a hash into fewer bits."""
    while data.shape[1] > words:
        half = data.shape[1] // 2
        data = data[:, :half] ^ data[:, half:]
    return data


# Passes over the texts


def sets_of(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, key, n, digest, node, signatures): signatures once per task for each distinct set, else null."""

    def run(batches):
        seen: set[bytes] = set()  # digests of one task's rows
        limits = bands(percent, 1 << 10)
        for batch in batches:
            sizes, digests, nodes, marks = [], [], [], []
            for text in batch.column("text").to_pylist():
                elements = shingle_set(text, shingle)
                n = len(elements)
                digest = xxhash.xxh3_128_digest(elements.tobytes())
                if limits[-2][1] < n:
                    limits = bands(percent, 2 * n)
                mark = None
                if n and digest not in seen:
                    seen.add(digest)
                    of = bisect_left(limits, n, key=lambda limit: limit[1])
                    mark = both_signatures(elements, of, limits, percent).view(np.int64)
                sizes.append(n)
                digests.append(digest)
                nodes.append(int.from_bytes(digest[:8], "big", signed=True))
                marks.append(mark)
            arrays = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), *arrays], ["doc_id", "key", "n", "digest", "node", "signatures"])

    return rows.mapInArrow(run, "doc_id BIGINT, key BIGINT, n BIGINT, digest BINARY, node BIGINT, signatures ARRAY<BIGINT>")


def elements_of(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, digest, n, elements ARRAY<BIGINT>, sketch) of each row's set."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                found = [shingle_set(t, shingle) for t in batch.column("text").slice(at, 100).to_pylist()]
                digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in found]
                nodes = [int.from_bytes(d[:8], "big", signed=True) for d in digests]
                arrays = [pa.array(nodes, pa.int64()), pa.array(digests, pa.binary()), pa.array([len(x) for x in found], pa.int64())]
                more = [pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), pa.array([sketch(x) for x in found], pa.binary())]
                yield pa.record_batch([*arrays, *more], ["node", "digest", "n", "elements", "sketch"])

    return rows.mapInArrow(run, "node BIGINT, digest BINARY, n BIGINT, elements ARRAY<BIGINT>, sketch BINARY")


# Lists of sets that share a signature


def lists_of(postings: DataFrame) -> DataFrame:
    """(signature, node, head): the lists of two distinct nodes or more, each node once, head being the smallest."""
    names = ["signature", "node", "head"]

    def run(batches):
        last, head, alone = None, None, False  # the row before, its list's first node, whether that was held back
        for batch in batches:
            marks, nodes = (batch.column(c).to_numpy() for c in ("signature", "node"))
            if not len(marks):
                continue
            if last is not None:
                marks, nodes = np.append(last[0], marks), np.append(last[1], nodes)
            new = np.append(True, marks[1:] != marks[:-1])
            if last is not None:
                new[0] = False
            fresh = new | np.append(last is None, nodes[1:] != nodes[:-1])
            starts = np.flatnonzero(new)
            # The smallest node of each row's list: that of the last start, or the one brought along.
            group = np.cumsum(new) - 1
            heads = np.where(group < 0, head if head is not None else 0, nodes[starts[np.maximum(group, 0)]] if len(starts) else 0)
            members = fresh & ~new
            if last is not None:
                members[0] = False
            # A head is given with the first other member of its list.
            firsts = np.flatnonzero(members)
            firsts = firsts[np.append(True, group[firsts][1:] != group[firsts][:-1])] if len(firsts) else firsts
            if not alone and len(firsts) and group[firsts[0]] < 0:
                firsts = firsts[1:]
            out = [np.concatenate([marks[firsts], marks[members]]), np.concatenate([heads[firsts], nodes[members]]), np.concatenate([heads[firsts], heads[members]])]
            begun = group[-1] >= 0
            alone = not (members & (group == group[-1])).any() and (begun or alone)
            last, head = (marks[-1], nodes[-1]), heads[-1]
            if len(out[0]):
                yield pa.record_batch([pa.array(x.astype(np.int64)) for x in out], names)

    dealt = postings.repartition("signature").sortWithinPartitions("signature", "node")
    return dealt.mapInArrow(run, "signature BIGINT, node BIGINT, head BIGINT")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs of nodes whose sets link; compared one pair at a time, on all elements."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("elements").alias("of_b"))
    small = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"))
    sizes = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"))
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = pairs.join(sizes, "a").join(small, "b").where(near).select("a", "b")
    whole = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return whole.where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def links_within(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): links that connect components of one family, no more of them than a block has members.

    ``members`` has (family, node, component, n, sketch, elements). Families are dealt in blocks of hashed members, also by their
    elements, and a task compares two blocks at a time: sizes and sketches first, then, nearest first, the elements of what isn't
    connected by then.
    """
    weight = F.greatest(F.count("*") / block, F.sum("n") / BLOCK_ELEMENTS)
    sizes = members.groupBy("family").agg(F.ceil(weight).alias("blocks"))
    dealt = members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    columns = [F.col("family").alias("key"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block"]
    dealt = dealt.select(*columns, "node", "component", "n", "sketch", "elements")

    def compared(part: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that sizes and sketches admit, nearest first."""
        n, size = part["n"], len(part["n"])
        may = part["component"][:, None] != part["component"][None, :]
        may &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
        if part["i"][0] != part["j"][0]:
            may &= part["block"][:, None] != part["block"][None, :]
        a, b = np.nonzero(np.triu(may, 1))
        words = np.array([len(x) // 8 for x in part["sketch"]])
        least = np.minimum(words[a], words[b])
        apart = np.zeros(len(a), np.int64)
        for w in np.unique(least):
            rows = np.zeros((size, w), np.uint64)
            for k in np.flatnonzero(words >= w):
                rows[k] = _folded(np.frombuffer(part["sketch"][k], np.uint64)[None, :], w)[0]
            at = np.flatnonzero(least == w)
            for low in range(0, len(at), 1 << 14):
                s = at[low : low + (1 << 14)]
                apart[s] = np.bitwise_count(rows[a[s]] ^ rows[b[s]]).sum(1, dtype=np.int64)
        keep = (100 + percent) * apart <= (100 - percent) * (n[a] + n[b])
        order = np.argsort(apart[keep], kind="stable")
        return a[keep][order], b[keep][order]

    def forest(part: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        root = {c: c for c in part["component"].tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found, component, elements = [], part["component"], part["elements"]
        for x, y in zip(*(e.tolist() for e in compared(part)), strict=True):
            p, q = find(int(component[x])), find(int(component[y]))
            if p != q:
                both = len(np.intersect1d(elements[x], elements[y], assume_unique=True))
                if 100 * both >= percent * (len(elements[x]) + len(elements[y]) - both):
                    root[p] = q
                    found.append((int(part["node"][x]), int(part["node"][y])))
        return found

    def run(batches):
        for columns in whole_runs(batches):
            new = np.append(True, np.any([columns[c][1:] != columns[c][:-1] for c in ("key", "i", "j")], axis=0))
            starts = np.flatnonzero(new).tolist()
            for s, e in zip(starts, [*starts[1:], len(new)], strict=True):
                found = forest({name: x[s:e] for name, x in columns.items()}) if e - s > 1 else []
                if found:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    with small_batches(members.sparkSession):
        return stored(dealt.mapInArrow(run, "a BIGINT, b BIGINT"), "setjoin-more")


# Operator


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the components of links at a similarity of ``percent`` / 100."""
    rows = texts(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    sets = stored(sets_of(rows, shingle, percent), "setjoin-sets")
    postings = sets.where("signatures IS NOT NULL").select(F.explode("signatures").alias("signature"), "node")
    listed = stored(lists_of(postings), "setjoin-lists")
    # The sets of all who stand in a list, from one document each.
    nodes = listed.select("node").distinct()
    keys = sets.select("node", "digest", "key").join(nodes, "node").groupBy("digest").agg(F.min("key").alias("key")).select("key").distinct()
    whole = stored(elements_of(rows.join(keys, "key").select("text"), shingle).dropDuplicates(["digest"]), "setjoin-elements")
    tried = stored(listed.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "setjoin-tried")
    links = stored(verified(tried, whole, percent), "setjoin-links")
    groups = connected_components(links)
    # Lists that still hold several components, and the families of sets that such lists connect.
    placed = listed.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = stored(placed, "setjoin-placed")
    several = placed.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("signature")
    still = stored(placed.join(several, "signature").select("node", "head", "component").distinct(), "setjoin-open")
    families = connected_components(still.select(F.col("node").alias("a"), F.col("head").alias("b"))).select("node", F.col("component").alias("family"))
    members = still.select("node", "component").distinct().join(families, "node").join(whole.drop("digest"), "node")
    groups = connected_components(links.unionByName(links_within(members, percent, block)))
    # A component is named by its smallest id; a set by its digest, of which a node is half.
    first = sets.where("n > 0").groupBy("digest", "node").agg(F.min("doc_id").alias("first_id"))
    named = first.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(ids, "component").select("digest", "component_id")
    out = sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS s
  FROM words
), sets AS (SELECT doc_id, list(hash(s) ORDER BY hash(s)) AS e, count(*) AS n FROM shingles GROUP BY doc_id
), whole AS (SELECT e, min(doc_id) AS id, any_value(n) AS n FROM sets GROUP BY e
), elements AS (SELECT id, n, unnest(e) AS s FROM whole
), links AS (
  SELECT a.id AS a, b.id AS b FROM elements a JOIN elements b ON a.s = b.s AND a.id < b.id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT id AS a, id AS b FROM whole UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b
), named AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN whole w ON w.e = s.e LEFT JOIN named c ON c.id = w.id
"""
