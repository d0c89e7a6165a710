"""Polygons' bytes as Arrow arrays, for tasks; ``functions.geometry`` has the columns.

Headers are walked row by row, coordinates are taken and put as whole runs of doubles.
"""

from __future__ import annotations

import struct
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# WKB type codes, and the flag of a spatial reference number behind the code.
POLYGON, MULTIPOLYGON, SRID = 3, 6, 0x20000000


def _head(data: bytes, at: int) -> tuple[str, int, int]:
    """(byte order, kind, where the content begins)"""
    order = {0: ">", 1: "<"}[data[at]]
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    return order, code & ~SRID, at + (9 if code & SRID else 5)


def _runs(data: bytes) -> list[list[np.ndarray]]:
    """The coordinates of each polygon's rings; raises where the bytes are something else."""
    order, kind, at = _head(data, 0)
    count, found = 1, []
    if kind == MULTIPOLYGON:
        (count,) = struct.unpack_from(order + "I", data, at)
        at += 4
    else:
        at = 0
    for _ in range(count):
        order, kind, at = _head(data, at)
        if kind != POLYGON:
            raise ValueError(kind)
        (rings,) = struct.unpack_from(order + "I", data, at)
        at += 4
        found.append([])
        for _ in range(rings):
            (points,) = struct.unpack_from(order + "I", data, at)
            found[-1].append(np.frombuffer(data, order + "f8", 2 * points, at + 4) if points else NONE)
            at += 4 + 16 * points
    if at != len(data):
        raise ValueError(at)
    return found


NONE = np.zeros(0)


def read(wkb: pa.Array) -> pa.Array:
    shapes: list[list[list[np.ndarray]] | None] = []
    for data in wkb.to_pylist():
        try:
            shapes.append(None if data is None else _runs(data))
        except (KeyError, IndexError, ValueError, struct.error):
            shapes.append(None)
    for k, shape in enumerate(shapes):
        if shape and not all(np.isfinite(ring).all() for polygon in shape for ring in polygon):
            shapes[k] = None
    polygons = [p for s in shapes if s for p in s]
    rings = [r for p in polygons for r in p]
    numbers = np.concatenate([NONE, *rings])
    points = pa.StructArray.from_arrays([pa.array(numbers[0::2]), pa.array(numbers[1::2])], ["x", "y"])
    found = pa.ListArray.from_arrays(_offsets([len(r) // 2 for r in rings]), points)
    found = pa.ListArray.from_arrays(_offsets(list(map(len, polygons))), found)
    missing = pa.array([s is None for s in shapes], pa.bool_())
    return pa.ListArray.from_arrays(_offsets([len(s or ()) for s in shapes]), found, mask=missing)


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.cumsum([0, *sizes]), pa.int32())


def write(geometry: pa.Array) -> pa.Array:
    # Offsets as they are, as a slice of an array has the values of the whole.
    polygons = geometry.values
    rings = polygons.values
    points = rings.values
    x, y = (points.field(k) for k in (0, 1))
    numbers = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in (x, y)], 1) + 0.0  # no negative zeros
    bad = ~np.isfinite(numbers).all(1) | points.is_null().to_numpy(zero_copy_only=False)
    bad = np.append(0, np.cumsum(bad))
    data = numbers.astype(">f8").tobytes()
    of_shapes, of_polygons, of_rings = (a.offsets.to_pylist() for a in (geometry, polygons, rings))
    void, no_polygon, no_ring = (a.is_null().to_pylist() for a in (geometry, polygons, rings))
    found: list[bytes | None] = []
    for k, empty in enumerate(void):
        own = range(of_shapes[k], of_shapes[k + 1])
        whole = not empty and not any(no_polygon[p] for p in own)
        parts = [struct.pack(">BII", 0, MULTIPOLYGON, len(own))]
        for p in own if whole else ():
            parts.append(struct.pack(">BII", 0, POLYGON, of_polygons[p + 1] - of_polygons[p]))
            for r in range(of_polygons[p], of_polygons[p + 1]):
                begin, end = of_rings[r], of_rings[r + 1]
                whole = whole and not no_ring[r] and bad[begin] == bad[end]
                parts += [struct.pack(">I", end - begin), data[16 * begin : 16 * end]]
        found.append(b"".join(parts) if whole else None)
    return pa.array(found, pa.binary())
