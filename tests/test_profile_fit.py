import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inline import by
from landcompare.operators.fit import axis_labels, fit
from landcompare.operators.profile import profile

INF, NAN = math.inf, math.nan
RANGES = ("min_all", "max_all", "min_finite", "max_finite")


def test_profile(spark):
    rows = [
        (1.0, 1.0, 1.0, 1.0),
        (2.0, None, 2.0, 9.0),
        (-5.0, 3.0, NAN, 3.0),
        (7.0, 4.0, 4.0, INF),
        (3.0, 5.0, 5.0, 5.0),
    ]
    frame = spark.createDataFrame(rows, "clean double, nul double, nan double, inf double")
    got = by(profile(frame, frame.columns), "column", *RANGES)
    assert got == {
        "clean": (-5.0, 7.0, 1.0, 3.0),
        "nul": (None, None, 1.0, 5.0),
        "nan": (None, None, 1.0, 5.0),
        "inf": (1.0, INF, 1.0, 5.0),
    }


def test_profile_without_a_finite_row(spark):
    frame = spark.createDataFrame([(1.0, None), (2.0, INF)], "a double, b double")
    assert by(profile(frame, ["a", "b"]), "column", *RANGES) == {
        "a": (1.0, 2.0, None, None),
        "b": (None, None, None, None),
    }


def test_profile_of_groups(spark):
    frame = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", None)], "g string, a double")
    got = by(profile(frame, ["a"], by=["g"]), "g", *RANGES)
    assert got == {"x": (1.0, 2.0, 1.0, 2.0), "y": (None, None, None, None)}


def points(spark, rows):
    return spark.createDataFrame(rows, "x double, y double")


def one(frame, space="identity"):
    [row] = fit(frame, "x", "y", space).collect()
    return row


def test_known_line(spark):
    row = one(points(spark, [(0.0, 1.0), (1.0, 3.0), (2.0, 5.0)]))
    assert (row.n, row.n_dropped, row.transform) == (3, 0, "identity")
    assert (row.slope, row.intercept, row.r2) == pytest.approx((2.0, 1.0, 1.0))
    assert (row.min_val, row.max_val) == (0.0, 5.0)


def test_log_space_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1e5, 300)
    y = x * rng.uniform(0.5, 2, 300)
    row = one(points(spark, [(float(a), float(b)) for a, b in zip(x, y)]), "log1p")
    slope, intercept = np.polyfit(np.log1p(x), np.log1p(y), 1)
    r2 = np.corrcoef(np.log1p(x), np.log1p(y))[0, 1] ** 2
    assert (row.slope, row.intercept, row.r2) == pytest.approx((slope, intercept, r2), rel=1e-9)
    assert (row.min_val, row.max_val) == (min(x.min(), y.min()), max(x.max(), y.max()))


def test_r2_is_unchanged_by_rescaling_x(spark):
    frame = points(spark, [(1.0, 2.0), (2.0, 1.0), (4.0, 5.0), (7.0, 3.0)])
    moved = frame.withColumn("x", F.col("x") * 12 - 100)
    assert one(frame).r2 == pytest.approx(one(moved).r2)
    assert 0 <= one(frame).r2 <= 1


@pytest.mark.parametrize(
    "rows, slope, r2",
    [
        ([(1.0, 1.0)], None, None),
        ([(1.0, 1.0), (1.0, 2.0)], None, None),
        ([(1.0, 4.0), (2.0, 4.0)], 0.0, None),
        ([(None, 4.0)], None, None),
    ],
)
def test_degenerate_lines(spark, rows, slope, r2):
    row = one(points(spark, rows))
    assert row.slope == slope and row.r2 == r2
    if slope is None:
        assert row.intercept is None


def test_unusable_pairs_are_dropped_and_counted(spark):
    good = [(0.0, 1.0), (1.0, 3.0), (2.0, 5.0)]
    bad = [(None, 9.0), (NAN, 1.0), (1.0, INF)]
    row = one(points(spark, good + bad))
    assert (row.n, row.n_dropped) == (3, 3)
    assert (row.slope, row.r2) == pytest.approx((2.0, 1.0))
    assert (row.min_val, row.max_val) == (0.0, INF)  # limits pass over NULL and NaN only
    negative = one(points(spark, [(0.0, 1.0), (1.0, 3.0), (-1.0, 2.0), (-7.0, 2.0)]), "log1p")
    assert (negative.n, negative.n_dropped, negative.min_val) == (2, 2, -7.0)


def test_empty_frame(spark):
    row = one(points(spark, []))
    assert (row.n, row.n_dropped, row.min_val, row.slope, row.r2) == (0, 0, None, None, None)


def test_axis_labels(spark):
    fits = fit(points(spark, [(-1234.4, 0.0), (5.0, 1e6)]), "x", "y", "identity")
    [row] = axis_labels(fits).collect()
    assert (row.min_label, row.max_label) == ("-1,234", "1,000,000")
