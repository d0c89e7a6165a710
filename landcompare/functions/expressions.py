"""Rates, shares, ratios and clamps as plain column expressions.

Division that the source data base does (``annual``, ``percent_of_area``) raises
on a zero divisor. Everything after the join follows IEEE rules, as a
statistics package does: NULL is missing, x/0 is infinite or NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def annual(total: Column, years: int | Column) -> Column:
    """Mean change per year of a total over a span of years."""
    years = years if isinstance(years, Column) else F.lit(years)
    return total.cast("double") / years.cast("double")


def percent_of_area(rate: Column, area: Column) -> Column:
    """Rate as percent (not fraction) of the zone's area; zero area raises."""
    return rate / area.cast("double") * F.lit(100.0)


def safe_ratio(num: Column, den: Column) -> Column:
    """IEEE division: x/0 is +-Inf, 0/0 and NaN/0 are NaN, NULL stays NULL."""
    num, den = num.cast("double"), den.cast("double")
    by_zero = (
        F.when(F.isnan(num) | (num == 0), F.lit(NAN)).when(num > 0, F.lit(INF)).otherwise(F.lit(-INF))
    )
    return (
        F.when(num.isNull() | den.isNull(), F.lit(None).cast("double"))
        .when(den == 0, by_zero)
        .otherwise(F.try_divide(num, den))
    )


def clamp(x: Column, limit: float) -> Column:
    """x held within +-limit; NULL and NaN pass through."""
    x = x.cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), x)
        .when(x <= -limit, F.lit(-float(limit)))
        .when(x >= limit, F.lit(float(limit)))
        .otherwise(x)
    )


def log1p(x: Column) -> Column:
    """ln(1+x), -Inf at -1 and NaN below, NULL and NaN pass through."""
    x = x.cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), x)
        .when(x > -1, F.log1p(x))
        .when(x == -1, F.lit(-INF))
        .otherwise(F.lit(NAN))
    )


def is_finite(x: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite; never NULL."""
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def is_number(x: Column) -> Column:
    """True for anything but NULL and NaN; never NULL."""
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x)


def fill_position(clamped: Column, limit: float | Column) -> Column:
    """Place of a clamped value on a colour ramp: 0 at -limit, 0.5 at 0, 1 at limit."""
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    return (clamped + limit) / (F.lit(2.0) * limit)


def thousands(x: Column) -> Column:
    """Axis label: whole number with thousands separators."""
    return F.format_number(x, 0)


def log10(x: Column) -> Column:
    """Decimal logarithm, -Inf at 0 and NaN below, NULL and NaN pass through."""
    x = x.cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), x)
        .when(x > 0, F.log10(x))
        .when(x == 0, F.lit(-INF))
        .otherwise(F.lit(NAN))
    )


TRANSFORMS = {
    "log1p": log1p,
    "identity": lambda x: x.cast("double"),
    "log10": log10,
    "log10_plus1": lambda x: log10(x.cast("double") + 1),
}


def transform(name: str, x: Column) -> Column:
    if name not in TRANSFORMS:
        raise KeyError(f"unknown transform {name!r}; known: {', '.join(TRANSFORMS)}")
    return TRANSFORMS[name](x)
