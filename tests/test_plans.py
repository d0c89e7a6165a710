"""What the plans must look like at any scale: with broadcasts off, the shuffles count."""

import re

import pytest

from inline import tables
from landcompare import Settings, Tables
from landcompare.operators.queries import query
from landcompare.plans.compare import compare, comparisons, long_frame
from landcompare.sources import testdata
from landcompare.sources.schemas import SPECS

FOLDER = "/root/testdata/sf0.001"
RAW = testdata.settings()


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def scans(plan, name):
    return re.findall(rf"FileScan parquet .*{name}\.parquet.*", plan)


@pytest.fixture(autouse=True)
def whole_texts(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def raw(spark):
    return testdata.tables(spark, FOLDER)


def test_net_scans_the_histogram_once(spark, tmp_path):
    tables(spark).save_parquet(str(tmp_path), "study_classes", "counties")
    plan = physical(query(Tables.from_parquet(spark, str(tmp_path)), Settings(), "counties", "net"))
    assert len(re.findall(r"FileScan parquet .*label", plan)) == 1


def test_label_and_columns_reach_the_scan(spark):
    plan = physical(query(raw(spark), RAW, "counties", "nlcd"))
    [scan] = scans(plan, "lineitem")
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R), IsNotNull(l_orderkey)]" in scan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_returnflag:string>" in scan


def test_classes_of_missing_measures_reach_the_scan(spark):
    [scan] = scans(physical(query(raw(spark), RAW, "counties", "nri")), "lineitem")
    assert "EqualTo(l_returnflag,A)" in scan
    plan = physical(query(raw(spark), RAW, "states", "nass"))
    assert [x for x in scans(plan, "orders") if "o_orderstatus" in x.split("PushedFilters")[1].split("ReadSchema")[0]]


@pytest.mark.parametrize("level", ["counties", "districts", "states"])
def test_comparisons_read_the_given_tables_once(spark, level):
    """And building them starts no job."""
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    frame = comparisons(raw(spark), RAW, level)
    plan = physical(frame)
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before
    assert len(scans(plan, "lineitem")) == 1 and len(scans(plan, "customer")) == 1
    assert len(scans(plan, "orders")) <= 2


@pytest.mark.parametrize("level", ["counties", "districts", "states"])
def test_comparisons_read_stored_tables_once(spark, tmp_path, level):
    tables(spark).save_parquet(str(tmp_path))
    plan = physical(comparisons(Tables.from_parquet(spark, str(tmp_path)), Settings(), level))
    reads = {n: len(re.findall(rf"FileScan parquet .*/{n}\]", plan)) for n in SPECS}
    limits = {"states": 2} if level == "states" else {}  # keys, then areas with geometry
    assert all(n <= limits.get(name, 1) for name, n in reads.items())
    assert sum(reads.values()) >= 4


@pytest.mark.parametrize("dataset", ["NRI", "NLCD", "NASS"])
def test_district_comparison_is_one_pass(spark, no_broadcast, dataset):
    plan = physical(compare(raw(spark), RAW, "districts", dataset))
    assert len(scans(plan, "customer")) == 1 and len(scans(plan, "lineitem")) <= 1 and len(scans(plan, "orders")) <= 2
    assert plan.count("Exchange") <= 12


def test_long_and_single_comparisons_agree(spark):
    for t, s in ((tables(spark), Settings()), (raw(spark), RAW)):
        for level in ("counties", "districts", "states"):
            apart = long_frame({n: compare(t, s, level, n) for n in s.level(level).datasets}, s, level)
            assert sorted(map(str, comparisons(t, s, level).collect())) == sorted(map(str, apart.collect()))


def test_county_nri_joins_customers_once(spark, no_broadcast):
    for frame in (query(raw(spark), RAW, "counties", "nri"), compare(raw(spark), RAW, "counties", "NRI")):
        assert len(scans(physical(frame), "customer")) == 1


def test_district_sums_do_not_compute_areas(spark):
    plan = physical(query(raw(spark), RAW, "districts", "exp"))
    assert len(scans(plan, "orders")) == 1


@pytest.mark.parametrize("source", ["exp", "net", "nass"])
def test_county_sum_and_join_share_one_shuffle(spark, no_broadcast, source):
    plan = physical(query(raw(spark), RAW, "counties", source))
    by_county = plan.count("Exchange hashpartitioning(atlas_stco")
    assert by_county == 3  # the measure, the area, the county table
    assert plan.count("Exchange hashpartitioning(o_custkey") == 0


def test_lines_are_combined_before_they_move(spark, no_broadcast):
    plan = physical(query(raw(spark), RAW, "states", "nlcd"))
    lines = plan[: plan.index("lineitem.parquet")].splitlines()
    exchange = max(i for i, line in enumerate(lines) if "Exchange hashpartitioning(l_orderkey" in line)
    assert "partial_sum" in lines[exchange + 1]


def test_county_table_joins_once_per_comparison(spark):
    plan = physical(compare(raw(spark), RAW, "counties", "NLCD"))
    assert len(scans(plan, "customer")) == 1


@pytest.mark.parametrize("source", ["nlcd", "nri", "nass"])
def test_no_geometry_in_an_aggregate_shuffle(spark, no_broadcast, source):
    frame = query(raw(spark), RAW, "states", source)
    assert "geom" in frame.columns
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in text.splitlines() if "Aggregate" in line and "geom" in line]


@pytest.mark.parametrize("level", ["counties", "districts", "states"])
@pytest.mark.parametrize("dataset", ["NRI", "NLCD", "NASS"])
def test_no_cross_join_no_python(spark, no_broadcast, level, dataset):
    plan = physical(compare(raw(spark), RAW, level, dataset))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "Window"):
        assert word not in plan


def test_derived_tables_keep_their_contract(spark):
    testdata.tables(spark, FOLDER).check()


def test_state_expansion_is_the_sum_of_counties(spark):
    t = raw(spark)
    counties = query(t, RAW, "counties", "exp").join(t["counties"].select("atlas_stco", "state_name"), "atlas_stco")
    summed = {r[0]: r[1] for r in counties.groupBy("state_name").sum("acres_study_per_year").collect()}
    got = {r.atlas_name: r.acres_study_per_year for r in query(t, RAW, "states", "exp").collect()}
    assert got == pytest.approx(summed)
