import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from landcompare.functions import expressions as E

INF, NAN = math.inf, math.nan


def same(a, b):
    if a is None or b is None:
        return a is b
    return (math.isnan(a) and math.isnan(b)) or a == b


def apply(spark, expression, values, columns="x double"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {columns}")
    return [r.y for r in frame.select("i", expression.alias("y")).orderBy("i").collect()]


def check(spark, expression, pairs, columns="x double"):
    got = apply(spark, expression, [p[0] for p in pairs], columns)
    assert all(same(g, p[1]) for g, p in zip(got, pairs)), (got, pairs)


def test_ratio_follows_ieee(spark):
    pairs = [
        ((1.0, 0.0), INF),
        ((-1.0, 0.0), -INF),
        ((0.0, 0.0), NAN),
        ((NAN, 0.0), NAN),
        ((None, 0.0), None),
        ((1.0, None), None),
        ((1.0, NAN), NAN),
        ((6.0, 4.0), 1.5),
        ((INF, 2.0), INF),
    ]
    check(spark, E.safe_ratio(F.col("x"), F.col("z")), pairs, "x double, z double")


@pytest.mark.parametrize("sat", [1.0, 0.2, 20.0])
def test_clamp(spark, sat):
    values = [-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 30.0, INF, -INF]
    pairs = [(v, max(-sat, min(sat, v))) for v in values] + [(None, None), (NAN, NAN)]
    check(spark, E.clamp(F.col("x"), sat), pairs)


def test_log1p(spark):
    pairs = [
        (-2.0, NAN),
        (-1.0, -INF),
        (-0.5, math.log1p(-0.5)),
        (0.0, 0.0),
        (10.0, math.log1p(10.0)),
        (None, None),
        (NAN, NAN),
        (INF, INF),
    ]
    check(spark, E.log1p(F.col("x")), pairs)


def test_finite_is_never_null(spark):
    pairs = [(1.0, True), (0.0, True), (None, False), (NAN, False), (INF, False), (-INF, False)]
    assert apply(spark, E.is_finite(F.col("x")), [p[0] for p in pairs]) == [p[1] for p in pairs]
    pairs = [(1.0, True), (None, False), (NAN, False), (INF, True)]
    assert apply(spark, E.is_number(F.col("x")), [p[0] for p in pairs]) == [p[1] for p in pairs]


def test_annual_divides_whole_numbers_as_real_ones(spark):
    assert apply(spark, E.annual(F.col("x"), 8), [7], "x int") == [0.875]
    assert apply(spark, E.annual(F.col("x"), 10), [7], "x bigint") == [0.7]


def test_share_is_a_percentage_and_zero_area_raises(spark):
    share = E.percent_of_area(F.col("x"), F.col("z"))
    assert apply(spark, share, [(5.0, 1000.0)], "x double, z double") == [0.5]
    with pytest.raises(ArithmeticException):
        apply(spark, share, [(5.0, 0.0)], "x double, z double")


def test_fill_position(spark):
    check(spark, E.fill_position(F.col("x"), 0.2), [(-0.2, 0.0), (0.0, 0.5), (0.2, 1.0), (None, None)])


def test_thousands(spark):
    assert apply(spark, E.thousands(F.col("x")), [1234567.4, -1000.0, 12.0]) == ["1,234,567", "-1,000", "12"]


def test_unknown_transform():
    with pytest.raises(KeyError, match="identity"):
        E.transform("log2", None)


def test_log10(spark):
    rows = spark.createDataFrame([(x,) for x in (100.0, 1.0, 0.0, -0.5, -1.0, -2.0, float("nan"), None)], "x DOUBLE")
    got = [tuple(map(str, r)) for r in rows.select(E.transform("log10", F.col("x")), E.transform("log10_plus1", F.col("x"))).collect()]
    assert got[0][0] == "2.0" and abs(float(got[0][1]) - math.log10(101)) < 1e-12
    assert [a for a, _ in got[1:]] == ["0.0", "-inf", "nan", "nan", "nan", "nan", "None"]
    assert [b for _, b in got[2:]] == ["0.0", str(math.log10(0.5)), "-inf", "nan", "nan", "None"]


numbers = st.one_of(st.none(), st.floats(width=64), st.sampled_from([0.0, -1.0, 1.0, 0.2, -0.2]))


def r_ratio(a, b):
    if a is None or b is None:
        return None
    if b == 0:
        return NAN if math.isnan(a) or a == 0 else math.copysign(INF, a)
    return a / b


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(numbers, numbers), min_size=1, max_size=60))
def test_ratio_and_clamp_properties(spark, pairs):
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a double, b double")
    once = E.clamp(F.col("a"), 0.2)
    got = (
        frame.select(
            "i", E.safe_ratio(F.col("a"), F.col("b")).alias("r"), once.alias("c"), E.clamp(once, 0.2).alias("cc")
        )
        .orderBy("i")
        .collect()
    )
    for (a, b), row in zip(pairs, got):
        assert same(row.r, r_ratio(a, b))
        assert same(row.c, row.cc)
        if a is not None and not math.isnan(a):
            assert -0.2 <= row.c <= 0.2
            assert row.c == a or abs(a) > 0.2
