"""Hexagons, ramp colours and order-independent sums against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from landcompare.functions.colours import MISSING, RAMP, lab_of, ramp
from landcompare.operators.exact import exact_sums
from landcompare.operators.hexbins import ROW, hexbins

INF, NAN = math.inf, math.nan


def test_hexagons_are_the_nearest_centres(spark):
    rng = random.Random(5)
    rows = [(g, rng.gauss(0, 1) * s, rng.gauss(0, 1) * s) for g, s in (("a", 1), ("b", 50)) for _ in range(300)]
    rows += [("a", None, 1.0), ("a", NAN, 1.0), ("b", INF, 2.0), (None, 1.0, 4.0), (None, 3.0, 2.0), ("same", 7.0, 7.0), ("same", 7.0, 7.0), ("none", None, None)]
    frame = spark.createDataFrame(rows, "g string, x double, y double")
    got = hexbins(frame, "x", "y", F.lit("identity"), by=["g"], bins=9).collect()
    for group in ("a", "b", None):
        own = [r[1:] for r in rows if r[0] == group]
        values = [v for p in own for v in p if v is not None and math.isfinite(v)]
        low, step = min(values), (max(values) - min(values)) / 9
        counts = Counter()
        for x, y in own:
            if x is None or not math.isfinite(x):
                continue
            u, v = (x - low) / step, (y - low) / step
            counts[min(((q, r) for r in range(-2, 14) for q in range(-9, 13)), key=lambda c: (round((u - c[0] - c[1] / 2) ** 2 + (v - c[1] * ROW) ** 2, 8), c))] += 1
        assert {(r.q, r.r): r.n for r in got if r.g == group} == counts
        for r in (r for r in got if r.g == group):
            assert (r.x, r.y) == pytest.approx((low + (r.q + r.r / 2) * step, low + r.r * ROW * step))
    assert [(r.q, r.r, r.n, r.x, r.y) for r in got if r.g == "same"] == [(0, 0, 2, 7.0, 7.0)]
    assert not [r for r in got if r.g == "none"]


def test_hexagons_without_groups_and_in_logarithms(spark):
    frame = spark.createDataFrame([(0.0, math.e - 1), (math.e - 1, 0.0), (-1.0, 0.0), (-2.0, 1.0)], "x double, y double")
    got = hexbins(frame, "x", "y", F.lit("log1p"), bins=1).collect()
    assert sum(r.n for r in got) == 2
    assert hexbins(frame.limit(0), "x", "y", F.lit("log1p")).collect() == []


def colours(spark, places, **more):
    frame = spark.createDataFrame([(k, p) for k, p in enumerate(places)], "k int, p double")
    return [r[0] for r in frame.orderBy("k").select(ramp(F.col("p"), **more)).collect()]


def test_knots_and_ends_have_their_own_colours(spark):
    assert colours(spark, [k / 9 for k in range(10)]) == list(RAMP)
    assert colours(spark, [None, NAN, -0.1, 1.1, INF]) == [MISSING] * 5


def test_colours_between_knots(spark):
    # Published Lab values of sRGB red and blue, and grey that stays grey.
    assert lab_of("#ff0000") == pytest.approx((53.24, 80.09, 67.20), abs=0.02)
    assert lab_of("#0000ff") == pytest.approx((32.30, 79.19, -107.86), abs=0.02)
    assert colours(spark, [0.5], colours=("#000000", "#ffffff")) == ["#777777"]
    places = [random.Random(3).random() for _ in range(200)] + [0.0, 1.0, 1e-12]
    for place, colour in zip(places, colours(spark, places), strict=True):
        k = min(int(place * 9), 8)
        t = place * 9 - k
        want = [a * (1 - t) + b * t for a, b in zip(lab_of(RAMP[k]), lab_of(RAMP[k + 1]), strict=True)]
        assert math.dist(lab_of(colour), want) < 1.2  # half a level of each colour


def numbers(rng, kind):
    if kind == "wide":
        return [math.ldexp(rng.uniform(-1, 1), rng.randint(-1060, 1000)) for _ in range(60)]
    if kind == "cancels":
        some = [math.ldexp(rng.uniform(-1, 1), rng.randint(-80, 80)) for _ in range(40)]
        return [*some, *(-v for v in some), rng.uniform(-1, 1) * 1e-30]
    if kind == "powers":
        return [s * math.ldexp(1.0, e) * (1 + d) for e in range(-70, 70, 5) for s in (1, -1) for d in (0, 2.0**-52, -(2.0**-53))] + [2.0**60, -(2.0**-60)]
    if kind == "halves":
        return [1.0, 2.0**-53, 2.0**-53 * rng.choice([0.0, 2.0**-60, -(2.0**-60)])]
    return [rng.uniform(0, 1e6) for _ in range(300)]


def test_sums_equal_the_exact_ones(spark):
    rng = random.Random(11)
    groups = {f"{kind}{k}": numbers(rng, kind) for kind in ("wide", "cancels", "powers", "halves", "plain") for k in range(8)}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    for parts in (1, 7):
        rng.shuffle(rows)
        got = exact_sums(spark.createDataFrame(rows, "g string, v double").repartition(parts), "v", ["g"]).collect()
        assert {r.g: r.total for r in got} == {g: math.fsum(vs) for g, vs in groups.items()}


def test_sums_of_odd_values(spark):
    groups = {
        "nan": [1.0, NAN], "inf": [1.0, INF, INF], "both": [INF, -INF], "null": [None, None], "some": [None, 2.0],
        "zero": [0.0, -0.0], "tiny": [5e-324] * 3, "max": [1.7976931348623157e308] * 2, None: [0.1] * 10,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    got = {r.g: r.total for r in exact_sums(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    assert math.isnan(got.pop("nan")) and math.isnan(got.pop("both"))
    assert got == {"inf": INF, "null": None, "some": 2.0, "zero": 0.0, "tiny": 15e-324, "max": INF, None: math.fsum([0.1] * 10)}


def test_sums_without_keys_and_of_nothing(spark):
    frame = spark.createDataFrame([(0.1, 1)] * 10, "power double, upper int")  # names that clash
    assert [r[0] for r in exact_sums(frame, "power").collect()] == [1.0]
    assert exact_sums(frame.limit(0), "power", ["upper"]).collect() == []
