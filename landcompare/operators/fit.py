"""Scatter statistics: shared axis limits and the least-squares line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landcompare.functions.expressions import TRANSFORMS, is_finite, is_number, thousands, transform


def fit(frame: DataFrame, x: str, y: str, space: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """One row (per group): limits of both axes together, and y ~ x in the given space.

    The space is ``log1p`` or ``identity``; a column may name it per group.
    Limits are in raw units and pass over NULL and NaN. The line uses pairs that
    are finite after the transform; ``n`` and ``n_dropped`` count the used and
    the unused ones. R2 and its line are NULL for fewer than two points or a
    constant x, R2 also for a constant y.
    """
    varying = isinstance(space, Column)

    def moved(name: str) -> Column:
        if not varying:
            return transform(space, F.col(name))
        return F.coalesce(*[F.when(space == t, change(F.col(name))) for t, change in TRANSFORMS.items()])

    rows = frame.select(
        *by,
        *([space.alias("transform")] if varying else []),
        F.col(x).cast("double").alias("_x"),
        F.col(y).cast("double").alias("_y"),
        moved(x).alias("_tx"),
        moved(y).alias("_ty"),
    ).withColumn("_ok", is_finite(F.col("_tx")) & is_finite(F.col("_ty")))

    def known(name: str) -> Column:
        return F.when(is_number(F.col(name)), F.col(name))

    px, py = F.when(F.col("_ok"), F.col("_tx")), F.when(F.col("_ok"), F.col("_ty"))
    spread = (F.col("n") >= 2) & (F.col("_min_x") < F.col("_max_x"))
    found = (
        rows.groupBy(*by, *(["transform"] if varying else []))
        .agg(
            F.count_if("_ok").alias("n"),
            F.count_if(~F.col("_ok")).alias("n_dropped"),
            F.least(F.min(known("_x")), F.min(known("_y"))).alias("min_val"),
            F.greatest(F.max(known("_x")), F.max(known("_y"))).alias("max_val"),
            F.regr_slope(py, px).alias("slope"),
            F.regr_intercept(py, px).alias("intercept"),
            F.regr_r2(py, px).alias("r2"),
            F.min(px).alias("_min_x"),
            F.max(px).alias("_max_x"),
            F.min(py).alias("_min_y"),
            F.max(py).alias("_max_y"),
        )
        .withColumns(
            {
                "slope": F.when(spread, F.col("slope")),
                "intercept": F.when(spread, F.col("intercept")),
                "r2": F.when(spread & (F.col("_min_y") < F.col("_max_y")), F.col("r2")),
                "transform": F.col("transform") if varying else F.lit(space),
            }
        )
    )
    return found.drop("_min_x", "_max_x", "_min_y", "_max_y")


def axis_labels(fits: DataFrame) -> DataFrame:
    """The limits as the axes print them."""
    return fits.withColumns(
        {"min_label": thousands(F.col("min_val")), "max_label": thousands(F.col("max_val"))}
    )
