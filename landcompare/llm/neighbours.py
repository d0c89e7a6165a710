"""Approximate nearest neighbours by learned partitions.

On a bounded sample a graph of nearest neighbours is cut into balanced parts with few
edges between them (spectral bisection, then swaps), and a small network learns which
part a vector's neighbours lie in. The network files every vector of the corpus under
its most probable part and routes each query to the several most probable ones, where
all candidates are ranked by the exact inner product. How many is measured in the fit: a
tenth of the sample is kept from it, and the fewest parts are taken with which these
vectors find the wanted share of their nearest. Vectors without clusters need most parts,
clustered ones few.

Parts differ in size, and a vector that fills a third of all rows fills one part. So
candidates and queries of a part are dealt in blocks, and each block of queries meets
each block of candidates in a task of its own: no task holds more than two blocks. The
twenty best of each meeting are merged by query.

Rows: vectors that are null, empty, zero, not of the most frequent length, or hold null
or non-finite components take no part, nor do rows with a null id; identical rows count
once, different vectors under one id each count. Fewer candidates than asked for give
fewer rows; no usable vector gives none. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landcompare.llm.common import stored, table

NEIGHBOURS, QUERY_EVERY = 20, 20
SAMPLE = 6_000  # distinct vectors that graph and network are fitted on
PARTS, RECALL = 32, 0.94  # what as many probes as needed reach on sampled vectors that were not fitted
DEGREE, HIDDEN, EPOCHS, RATE = 20, 128, 30, 0.003
BLOCK = 2_048


# Fit, in one task on the sample


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The indices of each row's nearest others, by inner product, in blocks of rows."""
    found = []
    for start in range(0, len(x), 1024):
        near = x[start : start + 1024] @ x.T
        near[np.arange(len(near)), start + np.arange(len(near))] = -np.inf
        found.append(np.argpartition(-near, degree - 1, axis=1)[:, :degree])
    return np.concatenate(found)


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Halves the graph again and again, parts being a power of two; sizes differ by one per halving."""
    label = np.zeros(len(graph), np.int64)
    for _ in range(parts.bit_length() - 1):
        after = np.zeros_like(label)
        for old in range(label.max() + 1):
            rows = np.flatnonzero(label == old)
            after[rows] = 2 * old + _halved(graph, rows)
        label = after
    return label


def _halved(graph: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n = len(rows)
    if n < 2:
        return np.zeros(n, np.int64)
    place = np.full(len(graph), -1)
    place[rows] = np.arange(n)
    ends = place[graph[rows]]
    a, b = np.repeat(np.arange(n), graph.shape[1])[ends.ravel() >= 0], ends.ravel()[ends.ravel() >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(a, minlength=n) + 1.0
    # The second eigenvector of the normalised graph, by power iteration on (I + D^-1/2 A D^-1/2) / 2.
    root = np.sqrt(degree)
    first = root / np.linalg.norm(root)
    v = np.random.default_rng(n).standard_normal(n)
    for _ in range(80):
        v -= first * (first @ v)
        u = v / root
        v = (v + (np.bincount(a, u[b], n) + u) / root) / 2
        v /= np.linalg.norm(v) or 1.0
    side = np.zeros(n, np.int64)
    side[np.argsort(v / root, kind="stable")[n // 2 :]] = 1
    # Swaps: equally many of each side move, those with most neighbours across first.
    for _ in range(10):
        across = np.bincount(a, side[a] != side[b], n)
        gain = 2 * across - np.bincount(a, minlength=n)
        left, right = (np.flatnonzero(side == s) for s in (0, 1))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        good = int((gain[left[:m]] + gain[right[:m]] > 2).sum()) // 4
        if not good:
            break
        side[left[:good]], side[right[:good]] = 1, 0
    return side


def train(x: np.ndarray, label: np.ndarray, graph: np.ndarray, parts: int) -> list[np.ndarray]:
    """A network with one hidden layer for the share of a vector's neighbours in each part; Adam."""
    rng = np.random.default_rng(7)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    target[np.arange(len(x)), label] += 1.0
    target /= target.sum(1, keepdims=True)
    w = [
        rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]),
        np.zeros(HIDDEN),
        rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN),
        np.zeros(parts),
    ]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for start in range(0, len(x), 256):
            at = order[start : start + 256]
            h = np.maximum(x[at] @ w[0] + w[1], 0)
            e = (_softmax(h @ w[2] + w[3]) - target[at]) / len(at)
            back = (e @ w[2].T) * (h > 0)
            grads = [x[at].T @ back, back.sum(0), h.T @ e, e.sum(0)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def routes(model: dict, x: np.ndarray, count: int) -> np.ndarray:
    """The most probable parts of each row, most probable first."""
    w = model["weights"]
    z = np.maximum(x / model["scale"] @ w[0] + w[1], 0) @ w[2] + w[3]
    return np.argsort(-z, axis=1, kind="stable")[:, :count]


def probes_for(model: dict, filed: np.ndarray, asked: np.ndarray, parts: int) -> int:
    """The fewest parts with which ``asked`` find the share ``RECALL`` of their nearest among ``filed``."""
    own = routes(model, filed, 1)[:, 0]
    place = np.argsort(routes(model, asked, parts), axis=1)  # of each part among a query's routes
    count = min(NEIGHBOURS, len(filed))
    near = np.concatenate([np.argpartition(-(asked[k : k + 256] @ filed.T), count - 1, axis=1)[:, :count] for k in range(0, len(asked), 256)])
    ranks = np.take_along_axis(place, own[near], axis=1)
    return next(p for p in range(1, parts + 1) if (ranks < p).mean() >= RECALL)


def fit(vectors: DataFrame, sample: int = SAMPLE, parts: int = PARTS) -> dict:
    """The model from the vectors whose contents have the smallest hashes; repeated vectors count once."""
    hashed = vectors.groupBy(F.xxhash64("vector").alias("h")).agg(F.min("vec_id").alias("vec_id"))
    chosen = F.broadcast(hashed.orderBy("h", "vec_id").limit(sample))  # at most `sample` pairs of numbers
    rows = vectors.withColumn("h", F.xxhash64("vector")).join(chosen, ["vec_id", "h"]).dropDuplicates(["h"]).select("vector", "h")

    def learn(batches):
        found = [_matrix(b.column("vector")) for b in batches if b.num_rows]
        x = np.concatenate(found) if found else np.zeros((0, 1))
        scale = float(np.sqrt((x**2).mean())) or 1.0 if len(x) else 1.0
        x = x / scale
        held = np.arange(len(x)) % 10 == 9
        rest, asked = x[~held], x[held]
        own = parts
        while own > 1 and len(rest) < 8 * own:
            own //= 2
        weights = [np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)]
        if own > 1:
            graph = neighbour_graph(rest, min(DEGREE, len(rest) - 1))
            weights = train(rest, balanced_parts(graph, own), graph, own)
        model = {"scale": 1.0, "weights": weights}
        probes = probes_for(model, rest, asked, own) if own > 1 and len(asked) else own
        yield pa.record_batch([pa.array([*map(float, range(6))]), pa.array([[scale], *(w.ravel().tolist() for w in weights), [float(probes)]])], ["k", "numbers"])

    # One task for a sample of bounded size, in an order that depends on the vectors alone.
    got = rows.repartition(1).sortWithinPartitions("h").mapInArrow(learn, "k DOUBLE, numbers ARRAY<DOUBLE>").collect()
    if not got:  # no vectors
        return {"scale": 1.0, "probes": 1, "weights": [np.zeros((1, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)]}
    scale, *weights, probes = (np.array(r["numbers"]) for r in sorted(got))
    n = len(weights[3])
    return {"scale": float(scale[0]), "probes": int(probes[0]), "weights": [weights[0].reshape(-1, HIDDEN), weights[1], weights[2].reshape(HIDDEN, n), weights[3]]}


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


# Search


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vector ARRAY<DOUBLE>) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    rows = rows.where(
        "vec_id IS NOT NULL AND size(vector) > 0 AND exists(vector, x -> x <> 0)"
        " AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    )
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (usual["n"] if usual else 0))


def nearest(vectors: DataFrame, queries: DataFrame, count: int = NEIGHBOURS, probes: int | None = None, model: dict | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, vector) its nearest of ``vectors``, itself left out.

    Both are frames as ``usable`` gives them. ``probes`` parts are searched, by default the model's number.
    """
    model = model or fit(vectors)
    probes = probes or model["probes"]
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def filed(how_many: int):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    part = routes(shared.value, _matrix(batch.column("vector")), how_many)
                    yield pa.record_batch([*batch.columns, pa.array(part.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "parts"])

        return run

    schema = "vec_id BIGINT, vector ARRAY<DOUBLE>, parts ARRAY<INT>"
    own = stored(vectors.mapInArrow(filed(1), schema).selectExpr("vec_id", "vector", "parts[0] AS part"), "parts")
    asked = stored(queries.mapInArrow(filed(probes), schema).select("vec_id", "vector", F.explode("parts").alias("part")), "routes")
    # Blocks per part: a few numbers for each of at most PARTS parts.
    sizes = own.groupBy("part").agg(F.ceil(F.count("*") / block).alias("blocks"))
    sizes = sizes.join(asked.groupBy("part").agg(F.ceil(F.count("*") / block).alias("query_blocks")), "part")
    mine, salt = F.xxhash64("vec_id", "vector"), F.lit(1)
    candidates = own.join(sizes, "part").withColumn("block", F.pmod(mine, "blocks")).withColumn("query_block", F.explode(F.expr("sequence(0L, query_blocks - 1)")))
    asking = asked.join(sizes, "part").withColumn("query_block", F.pmod(F.xxhash64("vec_id", "vector", salt), "query_blocks")).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    keys = ["part", "block", "query_block"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = left.column("vec_id").to_numpy(), _matrix(left.column("vector").combine_chunks())
        who, q = right.column("vec_id").to_numpy(), _matrix(right.column("vector").combine_chunks())
        found = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0)]]
        if len(ids) and len(who):
            ids, x = _distinct(ids, x)
            who, q = _distinct(who, q)
            for start in range(0, len(q), 256):
                found.extend(_best(who[start : start + 256], q[start : start + 256], ids, x, count))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    met = candidates.select(*keys, "vec_id", "vector").groupBy(*keys).cogroup(asking.select(*keys, "vec_id", "vector").groupBy(*keys))
    best = met.applyInArrow(meet, "query_id BIGINT, vec_id BIGINT, score DOUBLE")
    # A query's rows: `count` for each of its parts' blocks, ranked and cut.
    ranked = best.select("query_id", F.row_number().over(_order()).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= count)


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


def _distinct(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identical rows once, by id."""
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1))
    return ids[new], x[new]


def _best(who: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, count: int):
    """The ``count`` nearest of each query; ids ascend, so a stable sort settles ties."""
    scores = q @ x.T
    # A little more than the exact cut, by what sums in another order can differ.
    slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max() * x.shape[1]
    scores[who[:, None] == ids[None, :]] = -np.inf
    for k in range(len(who)):
        row = scores[k]
        cut = np.partition(row, len(row) - count)[len(row) - count] - slack[k] if len(row) > count else -np.inf
        at = np.flatnonzero((row >= cut) & (row > -np.inf))
        exact = (x[at] * q[k]).sum(1)  # in a fixed order, the same for equal vectors
        top = np.lexsort((ids[at], -exact))[:count]
        yield [np.full(len(top), who[k], np.int64), ids[at][top], exact[top]]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))
