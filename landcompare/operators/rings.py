"""Rings and chains of outline edges within a task's chunk, as numpy columns; ``coverage`` deals the edges and joins the chains."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 200_000  # ends of edges that a task looks at together
CHAINS = "owner BIGINT, id BIGINT, part BIGINT, x1 BIGINT, y1 BIGINT, dx BIGINT, dy BIGINT, following BIGINT, ring BIGINT, behind BOOLEAN, back BIGINT, closed BOOLEAN"


def chunks(batches: Iterator, most: int = CHUNK) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows as columns, cut where a square ends, or inside of one that alone is too large, where a vertex ends."""
    held: list[dict[str, np.ndarray]] = []
    n = 0
    for batch in batches:
        kept = batch.set_column(batch.schema.get_field_index("following"), "following", batch.column("following").fill_null(-1))
        held.append({name: kept.column(name).to_numpy(zero_copy_only=False) for name in kept.schema.names})
        n += batch.num_rows
        if n >= most:
            whole = {name: np.concatenate([h[name] for h in held]) for name in held[0]}
            at = np.flatnonzero(_new(whole, "owner", "row", "column"))[-1] or np.flatnonzero(_new(whole, "x", "y"))[-1]
            if at:
                yield {name: x[:at] for name, x in whole.items()}
            held = [{name: x[at:] for name, x in whole.items()}]
            n = len(held[0]["id"])
    if n:
        yield {name: np.concatenate([h[name] for h in held]) for name in held[0]}


def _new(columns: dict[str, np.ndarray], *names: str) -> np.ndarray:
    """Whether a row differs from the one before it; the first does."""
    found = np.zeros(len(columns[names[0]]), bool)
    found[:1] = True
    for name in names:
        found[1:] |= columns[name][1:] != columns[name][:-1]
    return found


def chains(ends: dict[str, np.ndarray], cut: bool) -> pa.RecordBatch:
    vertex = np.cumsum(_new(ends, "owner", "row", "column", "x", "y")) - 1
    out, into = np.flatnonzero(ends["leaves"]), np.flatnonzero(~ends["leaves"])
    target, met = _turned(ends, vertex, out, into)
    ids = ends["id"][out]
    by_id = np.argsort(ids)
    known = by_id[np.minimum(np.searchsorted(ids, ends["id"][into], sorter=by_id), len(out) - 1)] if len(out) else np.zeros(len(into), int)
    own = ids[known] == ends["id"][into] if len(out) else np.zeros(len(into), bool)
    link = np.full(len(out), -1)
    link[known[own & met]] = target[own & met]
    # Chains end where an edge has no link; what never ends is a ring.
    jump, steps = np.where(link < 0, np.arange(len(out)), link), (link >= 0).astype(np.int64)
    for _ in range(len(out).bit_length()):
        steps, jump = steps + steps[jump], jump[jump]
    closed = link[jump] >= 0
    ring, behind, back = ids[jump], np.ones(len(out), bool), -steps
    inner = np.flatnonzero(closed)
    if len(inner):
        place = np.zeros(len(out), np.int64)
        place[inner] = np.arange(len(inner))
        follow = place[link[inner]]
        least, left = ranked(ids[inner], follow)
        if cut:
            follow = _cut(follow, least, left, vertex[out][inner])
            least, left = ranked(ids[inner], follow)
        ring[inner], behind[inner], back[inner] = least, left > 0, -left
        link[inner] = inner[follow]
    following = np.where(link < 0, -1, ids[np.maximum(link, 0)]) if len(out) else link
    columns = {c: ends[c][out] for c in ("owner", "id", "part", "x", "y", "dx", "dy")} | {"following": following, "ring": ring, "behind": behind, "back": back, "closed": closed}
    # Links to edges that begin here, of edges that begin elsewhere.
    beyond = ~own & met
    cross = into[beyond]
    more = {c: ends[c][cross] for c in ("owner", "id", "part", "x", "y", "dx", "dy")} | {"following": ids[target[beyond]] if len(cross) else ids[:0]}
    none = len(cross)
    more |= {"ring": np.zeros(none, np.int64), "behind": np.zeros(none, bool), "back": np.zeros(none, np.int64), "closed": np.zeros(none, bool)}
    lacks = np.append(np.zeros(len(out), bool), np.ones(none, bool))
    names = [c.split()[0] for c in CHAINS.split(", ")]
    arrays = []
    for name, x in ((c, np.concatenate([columns[k], more[k]])) for c, k in zip(names, columns, strict=True)):
        arrays.append(pa.array(x, mask=lacks if name == "ring" else (x < 0) if name == "following" else None))
    return pa.record_batch(arrays, names)


def _turned(ends: dict[str, np.ndarray], vertex: np.ndarray, out: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per edge that comes in, which of those that leave its vertex follows: the given one, or the leftmost turn; and whether any does."""
    first, last = np.searchsorted(vertex[out], vertex[into], "left"), np.searchsorted(vertex[out], vertex[into], "right")
    several = np.flatnonzero(last - first > 1)
    if not len(several):
        return first, last > first
    sizes = (last - first)[several]
    pair = np.repeat(several, sizes)
    choice = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[pair]
    dx, dy = (ends[c][into][pair].astype(float) for c in ("dx", "dy"))
    ex, ey = (ends[c][out][choice].astype(float) for c in ("dx", "dy"))
    turn = np.arctan2(dx * ey - dy * ex, dx * ex + dy * ey)
    turn[ends["following"][into][pair] == ends["id"][out][choice]] = 9.0
    order = np.lexsort((turn, pair))
    best = order[np.append(pair[order][1:] != pair[order][:-1], True)]
    found = first.copy()
    found[pair[best]] = choice[best]
    return found, last > first


def ranked(ids: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``coverage.ranked`` within a chunk; edges that follow are given by their places."""
    ring, steps, jump, reach = ids.copy(), np.zeros(len(ids), np.int64), following, 1
    while True:
        moved = ring > ring[jump]
        if not moved.any():
            return ring, steps
        steps, ring = np.where(moved, steps[jump] + reach, steps), np.minimum(ring, ring[jump])
        jump, reach = jump[jump], reach * 2


def _cut(following: np.ndarray, ring: np.ndarray, steps: np.ndarray, vertex: np.ndarray) -> np.ndarray:
    """The edge into a ring's pass through a vertex goes on where the pass before left."""
    order = np.lexsort((-steps, steps > 0, vertex, ring))
    fresh = np.append(True, (ring[order][1:] != ring[order][:-1]) | (vertex[order][1:] != vertex[order][:-1]))
    last = np.append(np.flatnonzero(fresh)[1:], len(order)) - 1
    before = np.append(-1, order[:-1])
    before[fresh] = order[last]
    instead = np.empty(len(order), np.int64)
    instead[order] = before
    return instead[following]
