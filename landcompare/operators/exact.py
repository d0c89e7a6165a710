"""Sums of DOUBLE that do not depend on the order of rows.

Every number is split, without error, into two whole numbers over a power of two; the power
is one of some 66 that lie 32 bits apart. Whole numbers sum alike in any order. A row per key
and power is left, and the total is rounded to a double once. So the result is the double next
to the exact sum, for any partitioning, at any time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landcompare.functions.expressions import is_finite

STEP = 32  # bits between two powers
LOW = 44  # bits of the lower whole number; the upper one has as many at most
WHOLE = "decimal(38,0)"


def _scaled(x: Column, exponent: Column) -> Column:
    """x * 2**exponent in two halves, so that neither factor leaves the range of a double."""
    half = F.floor(exponent / 2)
    return x * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (exponent - half).cast("double"))


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast(WHOLE)


def _parts(x: Column) -> list[Column]:
    """power, upper and lower whole number of a finite x: x = (upper * 2**LOW + lower) * 2**(STEP * power)."""
    # The logarithm may be off by one near a power of two, hence 54 for the 52 bits below the first.
    power = F.when(x == 0, 0).otherwise(F.floor((F.floor(F.log2(F.abs(x))) - 54) / STEP)).cast("int")
    y = _scaled(x, -STEP * power)
    upper = F.floor(y / float(2**LOW))
    return [power, upper.cast("bigint"), (y - upper.cast("double") * float(2**LOW)).cast("bigint")]


def _digits(sums: Column) -> Column:
    """(rest, digits) of an array of (power, n) that ascends by one: each n below 2**STEP, what is above carried on."""
    base = _whole(2**STEP)

    def carried(state: Column, item: Column) -> Column:
        n = (state["rest"] + item["n"]).cast(WHOLE)
        digit = F.pmod(n, base).cast(WHOLE)
        rest = ((n - digit).cast(WHOLE) / base).cast(WHOLE)
        return F.struct(rest.alias("rest"), F.concat(state["digits"], F.array(F.struct(item["power"].alias("power"), digit.alias("n")))).alias("digits"))

    start = F.struct(_whole(0).alias("rest"), F.array().cast(f"array<struct<power:int,n:{WHOLE}>>").alias("digits"))
    return F.aggregate(sums, start, carried)


def _rounded(digits: Column) -> Column:
    """The double next to what the digits stand for, none of them negative."""
    held = F.filter(digits, lambda d: d["n"] != 0)
    top = F.element_at(held, -1)["power"]

    def digit(k: int) -> Column:
        return F.coalesce(F.try_element_at(F.filter(held, lambda d: d["power"] == top - k), F.lit(1))["n"], _whole(0))

    # Three digits have 65 bits at least; one more bit says whether anything lies below.
    below = F.exists(held, lambda d: d["power"] < top - 2)
    n = digit(0) * _whole(2 ** (2 * STEP + 1)) + digit(1) * _whole(2 ** (STEP + 1)) + digit(2) * 2 + F.when(below, 1).otherwise(0)
    return F.when(F.size(held) == 0, 0.0).otherwise(_scaled(n.cast(WHOLE).cast("double"), STEP * (top - 2) - 1))


def exact_sums(frame: DataFrame, x: str, by: Sequence[str] = (), name: str = "total") -> DataFrame:
    """(by..., name): the sum of a DOUBLE column per group, the same whatever the order of rows.

    NULLs count as nothing, a group of NULLs alone is NULL; NaN, or infinite numbers of both
    signs, give NaN; one sign of infinity gives that. Sums past the range of a double are
    infinite. An empty frame gives no row, without ``by`` too. Keys may be NULL. Two partial
    sums, each before it moves: by key and power, then by key, where at most 67 rows meet.
    """
    keys = {c: f"_by{k}" for k, c in enumerate(by)}
    value = F.col(x).cast("double")
    rows = frame.select(*[F.col(c).alias(k) for c, k in keys.items()], value.alias("_x"))
    fine = is_finite(F.col("_x"))
    power, upper, lower = (F.when(fine, p) for p in _parts(F.col("_x")))
    rows = rows.select(*keys.values(), power.alias("power"), upper.alias("upper"), lower.alias("lower"), F.when(~fine, F.col("_x")).alias("odd"))
    sums = rows.groupBy(*keys.values(), "power").agg(*[F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in ("upper", "lower")], F.sum("odd").alias("odd"))
    n = (F.col("upper").cast(WHOLE) * _whole(2**LOW)).cast(WHOLE) + F.col("lower")
    one = F.when(F.col("power").isNotNull(), F.struct("power", n.cast(WHOLE).alias("n")))
    # collect_list passes over NULL.
    sums = sums.groupBy(*keys.values()).agg(F.sort_array(F.collect_list(one)).alias("sums"), F.sum("odd").alias("odd"))
    places = F.sequence(F.col("sums")[0]["power"], F.element_at("sums", -1)["power"] + 4)
    table = F.map_from_entries("sums")
    full = F.transform(places, lambda k: F.struct(k.alias("power"), F.coalesce(F.try_element_at(table, k), _whole(0)).alias("n")))
    sums = sums.withColumn("full", F.when(F.size("sums") > 0, full))
    sums = sums.withColumns({"plus": _digits(F.col("full")), "minus": _digits(F.transform("full", lambda d: F.struct(d["power"].alias("power"), (-d["n"]).cast(WHOLE).alias("n"))))})
    total = F.when(F.col("plus.rest") < 0, -_rounded(F.col("minus.digits"))).otherwise(_rounded(F.col("plus.digits")))
    found = F.when(F.col("odd").isNotNull(), F.col("odd")).when(F.col("full").isNotNull(), total)
    return sums.select(*[F.col(k).alias(c) for c, k in keys.items()], found.alias(name))
