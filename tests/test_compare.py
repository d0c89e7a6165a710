import math

import pytest
from pyspark.sql import functions as F

from inline import STUDY, by, tables
from landcompare import MapSpec, Settings
from landcompare.functions.expressions import is_finite
from landcompare.operators.choropleth import by_map, map_values, saturate
from landcompare.plans.compare import choropleth, compare, comparisons, comparisons_by_map, fits, profiles

S = Settings()


def test_county_differences(spark):
    got = compare(tables(spark), S, "counties", "NLCD", "map3")
    assert got.columns == [
        "atlas_stco", "atlas_name", "acres_study_per_year", "acres_study_per_year_per_eu", "acres",
        "acres_per_year", "acres_per_year_per_eu", "acres_calc", "geom", "diff_acres", "diff_ratio", "col_sat",
    ]
    rows = by(got, "atlas_stco", "diff_acres", "diff_ratio", "col_sat")
    assert rows == {
        "01001": (1.0, 1.0, 0.2),
        "01003": (pytest.approx(-0.2), pytest.approx(-0.8), pytest.approx(-0.2)),
        "02003": (pytest.approx(-0.2), pytest.approx(-1.0), pytest.approx(-0.2)),
        "03001": (None, None, None),
    }


def test_nass_is_held_against_net(spark):
    got = by(compare(tables(spark), S, "states", "NASS"), "atlas_name", "acres_study_per_year", "acres_per_year")
    assert got == {"North": (8.0, 10.0), "South": (-3.0, -3.0)}


def test_district_comparison(spark):
    got = compare(tables(spark), S, "districts", "NLCD", "map3_diff_ratio")
    assert len(got.columns) == len(set(got.columns))  # state_name comes once
    rows = by(got, "district_unique", "state_name", "acres", "diff_acres", "diff_ratio", "x_log1p", "y_log1p")
    assert rows["N1"] == (
        "North", 3000.0, pytest.approx(0.2), pytest.approx(0.4), pytest.approx(math.log(16)),
        pytest.approx(math.log(22)),
    )


def test_zero_share_gives_infinite_ratio_not_an_error(spark):
    study = [("01001", "3", 0.0), ("01003", "3", 0.0), ("02003", "3", 0.0)]
    nlcd = [("01001", "4", 8.0), ("01003", "4", -8.0), ("02003", "4", 0.0)]
    t = tables(spark, study_classes=study, nlcd_classes=nlcd)
    got = by(compare(t, S, "counties", "NLCD"), "atlas_stco", "diff_ratio")
    assert got["01001"] == math.inf and got["01003"] == -math.inf and math.isnan(got["02003"])


def test_district_log_columns_of_negative_rates(spark):
    got = by(compare(tables(spark), S, "districts", "NASS"), "district_unique", "x_log1p", "y_log1p")
    assert got["N1"] == (pytest.approx(math.log(9)), pytest.approx(math.log(11)))
    assert all(math.isnan(v) for v in got["S1"])
    assert got["W1"] == (None, None)


def test_join_by_name_matches_namesakes(spark):
    study = [*STUDY, ("02001", "3", 8.0)]
    t = tables(spark, study_classes=study)
    assert compare(t, S, "counties", "NLCD").count() == 5
    named = compare(t, S, "counties", "NLCD", on="atlas_name")
    assert named.count() == 7  # both Adams counties match both
    pairs = {(r.atlas_stco, r.atlas_stco_comparison) for r in named.where("atlas_name = 'Adams'").collect()}
    assert pairs == {(a, b) for a in ("01001", "02001") for b in ("01001", "02001")}


def test_null_keys_match_nothing(spark):
    t = tables(spark, study_states=[(None, 1.0), ("North", 8.0)])
    assert [r.atlas_name for r in compare(t, S, "states", "NLCD").collect()] == ["North"]


@pytest.mark.parametrize("level", ["counties", "districts", "states"])
def test_long_frame_is_the_sum_of_its_parts(spark, level):
    t = tables(spark)
    long = comparisons(t, S, level)
    counts = {name: compare(t, S, level, name).count() for name in ("NRI", "NLCD", "NASS")}
    assert {r.dataset: r["count"] for r in long.groupBy("dataset").count().collect()} == counts
    drawn = S.level(level).drawn
    assert comparisons_by_map(long, S, level).count() == sum(counts.values()) * len(drawn)
    one = by(choropleth(long, S, level).where("dataset = 'NRI'"), ("map", "zone"), "col_sat")
    for m in drawn:
        single = compare(t, S, level, "NRI", m)
        key = {"counties": "atlas_stco", "districts": "district_unique", "states": "atlas_name"}[level]
        assert {z: v for (mm, z), v in one.items() if mm == m} == by(single, key, "col_sat")


def test_map_values(spark):
    frame = spark.createDataFrame(
        [("a", -3.0, b"1"), ("b", 0.1, b"2"), ("c", None, b"3"), ("d", math.nan, b"4")],
        "zone string, v double, geom binary",
    )
    got = by(map_values(frame, {"m": MapSpec("v", 0.2)}, "zone"), "zone", "col_sat", "fill_pos", "geom")
    assert got["a"] == (-0.2, 0.0, b"1")
    assert got["b"] == (0.1, pytest.approx(0.75), b"2")
    assert got["c"] == (None, None, b"3")
    assert math.isnan(got["d"][0])


def test_missing_map_column(spark):
    frame = spark.createDataFrame([(1.0,)], "v double")
    for use in (lambda m: saturate(frame, m), lambda m: by_map(frame, {"m": m})):
        with pytest.raises(ValueError, match="diff_acres"):
            use(MapSpec("diff_acres", 1.0))


def test_unknown_names():
    for call in (lambda: S.dataset("states", "XYZ"), lambda: S.map("states", "map9"), lambda: S.level("towns")):
        with pytest.raises(KeyError, match="known"):
            call()


def test_fits_and_profiles_use_every_dataset(spark):
    long = comparisons(tables(spark), S, "districts")
    got = by(fits(long, S, "districts"), "dataset", "transform", "n", "n_dropped")
    assert got == {"NRI": ("log1p", 2, 1), "NLCD": ("log1p", 2, 1), "NASS": ("identity", 2, 1)}
    assert profiles(long, S, "districts").count() == 18


def test_finite_rows_of_a_comparison(spark):
    frame = compare(tables(spark), S, "districts", "NASS")
    assert frame.where(is_finite(F.col("x_log1p"))).count() == 1
