"""Polygons as columns: WKB read and written, areas on the plane and on the sphere.

A geometry is an array of polygons, a polygon an array of rings (the shell first, then
its holes), a ring an array of points whose last one repeats the first. Areas are built-in
functions; bytes are read and written on Arrow arrays within tasks (``functions.wkb``), as
built-in functions have to put each double together from hex digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from landcompare.functions import wkb as wkb_module

POINT = "struct<x:double,y:double>"
GEOMETRY = f"array<array<array<{POINT}>>>"

ACRE = 4046.8564224  # square metres, fixed value
EARTH = 6371007.1809  # radius in metres of the sphere with the earth's surface, fixed value


def let(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def _upto(n: Column, start: int = 1) -> Column:
    """start, start + 1, ... n; empty if n is less."""
    return F.when(n >= start, F.sequence(F.lit(start).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>"))


# Bytes


def read_wkb(wkb: Column) -> Column:
    """The geometry in the bytes of a polygon or multipolygon, of either byte order, with or without a reference number.

    NULL if the bytes are anything else: another type or dimension, cut off, followed by more, or with a coordinate that isn't finite.
    """
    return F.arrow_udf(wkb_module.read, GEOMETRY)(wkb)


def write_wkb(geometry: Column) -> Column:
    """The bytes of a multipolygon, big end first; NULL if the geometry is NULL or a coordinate isn't finite. Negative zeros become zeros."""
    return F.arrow_udf(wkb_module.write, "binary")(geometry)


# Areas


def ring_area(ring: Column) -> Column:
    """Twice the halves of all triangles with the first point: above zero if the ring runs against the clock."""

    def whole(ring: Column) -> Column:
        first = F.get(ring, F.lit(0))

        def triangle(s: Column, k: Column) -> Column:
            a, b = F.get(ring, k - 1), F.get(ring, k)
            return s + (a["x"] - first["x"]) * (b["y"] - first["y"]) - (b["x"] - first["x"]) * (a["y"] - first["y"])

        return F.aggregate(_upto(F.size(ring).cast("bigint") - 1), F.lit(0.0), triangle) / 2

    return let(ring, whole)  # else a ring that is computed would be so at every point


def ring_excess(ring: Column) -> Column:
    """The same in steradians on the unit sphere, x and y being degrees of longitude and latitude, edges great circles.

    Each edge adds the triangle it forms with the pole, less that of the equator; rings must not hold a pole.
    """

    def whole(ring: Column) -> Column:
        def slice_(s: Column, k: Column) -> Column:
            a, b = F.get(ring, k - 1), F.get(ring, k)
            turn, up, over = (F.radians(v / 2) for v in (b["x"] - a["x"], a["y"] + b["y"], a["y"] - b["y"]))
            return s - 2 * F.atan2(F.sin(turn) * F.sin(up), F.cos(turn) * F.cos(over))

        return F.aggregate(_upto(F.size(ring).cast("bigint") - 1), F.lit(0.0), slice_)

    return let(ring, whole)


def area(geometry: Column, of_ring: Callable[[Column], Column] = ring_area) -> Column:
    """Shells less holes, whichever way their rings run; with ``ring_excess`` in steradians."""

    def polygon(s: Column, rings: Column) -> Column:
        sizes = F.transform(rings, lambda r: F.abs(of_ring(r)))
        holes = F.aggregate(F.slice(sizes, 2, F.greatest(F.size(sizes), F.lit(1))), F.lit(0.0), lambda t, x: t + x)
        return s + F.coalesce(F.get(sizes, F.lit(0)), F.lit(0.0)) - holes

    return F.aggregate(geometry, F.lit(0.0), polygon)


def acres(geometry: Column) -> Column:
    """Area in acres of a geometry in degrees."""
    return area(geometry, ring_excess) * F.lit(EARTH * EARTH / ACRE)
