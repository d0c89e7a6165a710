"""Colours on a ramp: piecewise linear in Lab space, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The colours of the maps from the lower to the upper limit, and that of a missing value.
RAMP = ("#003c30", "#01665e", "#35978f", "#80cdc1", "#c7eae5", "#fddbc7", "#f4a582", "#d6604d", "#b2182b", "#67001f")
MISSING = "#7f7f7f"

# sRGB under D65 daylight.
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
LINEAR = 6 / 29  # below it the cube root is replaced by a line


def lab_of(colour: str) -> tuple[float, float, float]:
    """Lightness and the two axes of a colour written as #rrggbb."""
    levels = [int(colour[k : k + 2], 16) / 255 for k in (1, 3, 5)]
    light = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in levels]
    shares = [sum(m * c for m, c in zip(row, light, strict=True)) / w for row, w in zip(TO_XYZ, WHITE, strict=True)]
    x, y, z = (t ** (1 / 3) if t > LINEAR**3 else t / (3 * LINEAR**2) + 4 / 29 for t in shares)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def rgb_of(lab: Sequence[Column]) -> list[Column]:
    """The three levels, 0 to 255, nearest to a colour in Lab space; what no screen shows is cut to its limits."""
    y = (lab[0] + 16) / 116
    roots = (y + lab[1] / 500, y, y - lab[2] / 200)
    xyz = [w * F.when(t > LINEAR, t * t * t).otherwise(3 * LINEAR**2 * (t - 4 / 29)) for t, w in zip(roots, WHITE, strict=True)]
    light = [row[0] * xyz[0] + row[1] * xyz[1] + row[2] * xyz[2] for row in TO_RGB]
    levels = [F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055) for c in light]
    return [F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int") for c in levels]


def ramp(position: Column, colours: Sequence[str] = RAMP, missing: str = MISSING) -> Column:
    """#rrggbb of a place from 0 to 1 on a ramp through equally spaced colours.

    A place on a knot gives the knot's own colour. NULL, NaN and places off the ramp give ``missing``.
    """
    position, last = position.cast("double"), len(colours) - 1
    inside = position.isNotNull() & ~F.isnan(position) & (position >= 0) & (position <= 1)
    place = F.when(inside, position) * last
    knot = F.least(F.floor(place), F.lit(last - 1)).cast("int")
    part = place - knot
    tables = [F.array(*map(F.lit, axis)) for axis in zip(*map(lab_of, colours), strict=True)]
    lab = [F.get(t, knot) * (1 - part) + F.get(t, knot + 1) * part for t in tables]
    return F.when(inside, F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c), 2, "0")) for c in rgb_of(lab)])).otherwise(missing)
