"""Ranges of columns, for checking results by eye."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landcompare.functions.expressions import is_finite, is_number

# The columns a district profile covers besides the two shares.
DERIVED = ("diff_acres", "diff_ratio", "x_log1p", "y_log1p")


def profile(frame: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per column: smallest and largest value, twice.

    ``min_all`` and ``max_all`` are NULL as soon as one value is missing (NULL or
    NaN) and may be infinite. ``min_finite`` and ``max_finite`` look only at rows
    in which every one of the columns is finite.

    All ranges come from one aggregate; columns turn into rows after it.
    """
    all_finite = reduce(lambda a, b: a & b, [is_finite(F.col(c)) for c in columns])
    rows = frame.select(*by, *[F.col(c).cast("double").alias(c) for c in columns], all_finite.alias("_ok"))

    def ranges(c: str) -> Column:
        value, ok = F.col(c), F.col("_ok")
        complete = F.count_if(~is_number(value)) == 0
        return F.struct(
            F.lit(c).alias("column"),
            F.when(complete, F.min(value)).alias("min_all"),
            F.when(complete, F.max(value)).alias("max_all"),
            F.min(F.when(ok, value)).alias("min_finite"),
            F.max(F.when(ok, value)).alias("max_finite"),
        )

    wide = rows.groupBy(*by).agg(F.array(*[ranges(c) for c in columns]).alias("_ranges"))
    return wide.select(*by, F.inline("_ranges"))
