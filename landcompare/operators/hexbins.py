"""Points of a scatter plot counted by hexagons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landcompare.functions.expressions import TRANSFORMS, is_finite

BINS = 35  # hexagons over the width of the plot
ROW = math.sqrt(3) / 2  # distance of two rows of hexagons one wide
FINE = 1_000_000_000  # places within a hexagon's width that are told apart


def hexagon(u: Column, v: Column) -> tuple[Column, Column]:
    """(q, r): the hexagon, one wide and standing on a corner, whose centre is nearest to a point.

    Its centre is (q + r / 2, r * ROW). The three cube coordinates, whole numbers of half a
    thousand millionth, are rounded, halves up, and the one that moved most is taken from the
    other two; where two moved alike, q before r. A point on an upright side, where the ends of
    an axis can lie, belongs to the smaller q.
    """
    u, r = (F.round(c * float(FINE)).cast("bigint") for c in (u, v / F.lit(ROW)))
    cube = (2 * u - r, 2 * r, -2 * u - r)
    near = [F.floor((c + FINE) / float(2 * FINE)).cast("bigint") for c in cube]
    moved = [F.abs(n * (2 * FINE) - c) for n, c in zip(near, cube, strict=True)]
    by_q = (moved[0] >= moved[1]) & (moved[0] >= moved[2])
    by_r = ~by_q & (moved[1] >= moved[2])
    q = -near[1] - near[2]
    q = F.when(by_q & (moved[0] == moved[2]), F.least(q, near[0])).when(by_q, q).otherwise(near[0])
    return q, F.when(by_r, -near[0] - near[2]).otherwise(near[1])


def hexbins(frame: DataFrame, x: str, y: str, space: Column, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """A row (per group) and hexagon that holds points: q, r, n and the centre in the given space.

    The space is a column that names a transform, one per group. Both axes share their limits:
    the least and largest value of x and y that is finite in the space. Points finite on both
    axes are counted. A group whose values are all alike is one hexagon. NULL groups are kept.
    The limits are one row per group, summed before they move; so are the counts.
    """

    def moved(name: str) -> Column:
        return F.coalesce(*[F.when(space == t, change(F.col(name))) for t, change in TRANSFORMS.items()])

    rows = frame.select(*by, moved(x).alias("_x"), moved(y).alias("_y"))
    rows = rows.withColumns({c: F.when(is_finite(F.col(c)), F.col(c)) for c in ("_x", "_y")})
    low, high = F.least(F.min("_x"), F.min("_y")), F.greatest(F.max("_x"), F.max("_y"))
    limits = rows.groupBy(*by).agg(low.alias("_low"), (high - low).alias("_range"))
    keys = {c: f"_by{k}" for k, c in enumerate(by)}
    limits = limits.withColumnsRenamed(keys)
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()] or [F.lit(True)]
    rows = rows.where("_x IS NOT NULL AND _y IS NOT NULL").join(limits, on)

    def placed(name: str) -> Column:
        return F.when(F.col("_range") > 0, (F.col(name) - F.col("_low")) / F.col("_range") * float(bins)).otherwise(0.0)

    q, r = hexagon(placed("_x"), placed("_y"))
    counts = rows.select(*by, "_low", "_range", q.alias("q"), r.alias("r")).groupBy(*by, "_low", "_range", "q", "r").agg(F.count("*").alias("n"))
    step = F.col("_range") / F.lit(float(bins))
    centre_x = F.col("_low") + (F.col("q") + F.col("r") / 2) * step
    return counts.select(*by, "q", "r", "n", centre_x.alias("x"), (F.col("_low") + F.col("r") * F.lit(ROW) * step).alias("y"))
