import pytest

from inline import by, frames, tables
from landcompare import Settings, Tables
from landcompare.operators.queries import query, study
from landcompare.operators.totals import net, net_by_self_join
from landcompare.sources.schemas import InvalidTable

S = Settings()
RATE, SHARE = "acres_study_per_year", "acres_study_per_year_per_eu"
OTHER, OTHER_SHARE = "acres_per_year", "acres_per_year_per_eu"


def test_county_expansion(spark):
    got = query(tables(spark), S, "counties", "exp")
    assert got.columns == ["atlas_stco", "atlas_name", RATE, SHARE]
    assert by(got, "atlas_stco", RATE, SHARE) == {
        "01001": (10.0, 1.0),
        "01003": (5.0, 0.25),
        "02003": (1.0, 0.2),
        "03001": (None, None),
    }


def test_county_net_needs_both_classes(spark):
    got = by(query(tables(spark), S, "counties", "net"), "atlas_stco", RATE, SHARE)
    assert got == {"01001": (8.0, 0.8), "02003": (-3.0, pytest.approx(-0.6)), "03001": (None, None)}


def test_one_scan_net_equals_self_join(spark):
    t = tables(spark)
    assert by(net(t, S), "atlas_stco", "total") == by(net_by_self_join(t, S), "atlas_stco", "total")


def test_self_join_multiplies_repeated_classes_and_check_refuses_them(spark):
    repeated = [("01001", "3", 80.0), ("01001", "3", 8.0), ("01001", "4", 16.0)]
    t = tables(spark, study_classes=repeated)
    assert net_by_self_join(t, S).count() == 2
    assert by(net(t, S), "atlas_stco", "total") == {"01001": 72.0}
    with pytest.raises(InvalidTable, match="study_classes: unique atlas_stco, label broken 1 times"):
        t.check()


def test_county_datasets(spark):
    t = tables(spark)
    nlcd = query(t, S, "counties", "nlcd")
    assert nlcd.columns == [
        "atlas_stco", "atlas_name", "acres", OTHER, OTHER_SHARE, "acres_calc", "geom",
    ]
    assert by(nlcd, "atlas_stco", "acres", OTHER, OTHER_SHARE, "geom")["01001"] == (160.0, 20.0, 2.0, b"g01001")
    nri = by(query(t, S, "counties", "nri"), "atlas_stco", OTHER)
    assert nri == {"01001": 1.0, "02001": 2.0, "02003": -1.0}  # missing ones are dropped
    nass = query(t, S, "counties", "nass")
    assert "acres" not in nass.columns
    assert by(nass, "atlas_stco", OTHER, OTHER_SHARE) == {
        "01001": (10.0, 1.0),
        "01003": (None, None),  # missing ones are kept
        "02001": (-5.0, pytest.approx(-0.125)),
        "02003": (2.0, 0.4),
        "03001": (None, None),
    }


@pytest.mark.parametrize(
    "source, want",
    [
        ("exp", {"N1": 15.0, "S1": 1.0, "W1": None}),
        ("net", {"N1": 8.0, "S1": -3.0, "W1": None}),
        ("nlcd", {"N1": 21.0, "S1": 5.0, "W1": 2.0}),
        ("nri", {"N1": 1.0, "S1": 1.0, "W1": None}),  # a district of missing values stays, as NULL
        ("nass", {"N1": 10.0, "S1": -3.0, "W1": None}),
    ],
)
def test_districts(spark, source, want):
    got = query(tables(spark), S, "districts", source)
    rate = S.rate(source)
    assert got.columns == ["district_unique", "state_name", rate]
    assert by(got, "district_unique", rate) == want


def test_district_nass_is_sorted_by_state(spark):
    rows = query(tables(spark), S, "districts", "nass").collect()
    assert [r.state_name for r in rows] == ["North", "South", "West"]


@pytest.mark.parametrize(
    "source, want",
    [
        ("exp", {"North": (15.0, 0.5), "South": (1.0, 1 / 4500 * 100), "West": (None, None)}),
        ("net", {"North": (8.0, 8 / 3000 * 100), "South": (-3.0, -3 / 4500 * 100), "West": (None, None)}),
        ("nlcd", {"North": (21.0, 0.7), "South": (5.0, 5 / 4500 * 100), "West": (2.0, 0.25)}),
        ("nri", {"North": (1.0, 1 / 3000 * 100), "South": (1.0, 1 / 4500 * 100), "West": (None, None)}),
        ("nass", {"North": (10.0, 10 / 3000 * 100), "South": (-3.0, -3 / 4500 * 100)}),  # no West
    ],
)
def test_states(spark, source, want):
    got = by(query(tables(spark), S, "states", source), "atlas_name", S.rate(source), S.share(source))
    assert {k: tuple(v if v is None else pytest.approx(v) for v in vs) for k, vs in want.items()} == got


def test_state_columns(spark):
    t = tables(spark)
    assert query(t, S, "states", "exp").columns == ["atlas_name", "acres_study", RATE, SHARE]
    assert query(t, S, "states", "net").columns == ["atlas_name", RATE, SHARE]
    assert query(t, S, "states", "nri").columns == ["atlas_name", "acres", OTHER, OTHER_SHARE, "geom"]
    assert query(t, S, "states", "nass").columns == ["atlas_name", OTHER, OTHER_SHARE, "geom"]


def test_state_net_takes_the_state_from_the_second_county_table(spark):
    moved = [("01001", "West"), ("02003", "South"), ("03001", "West")]
    got = by(query(tables(spark, county_states=moved), S, "states", "net"), "atlas_name", RATE)
    assert got == {"West": 8.0, "South": -3.0}


def test_district_study_adds_area_share_and_geometry(spark):
    got = by(study(tables(spark), S, "districts", "exp"), "district_unique", "acres", RATE, SHARE, "geom")
    assert got["N1"] == (3000.0, 15.0, 0.5, b"N1")
    assert got["W1"] == (800.0, None, None, b"W1")


def test_study_tag_names_the_columns(spark):
    tagged = Settings(study_tag="abc")
    assert query(tables(spark), tagged, "states", "exp").columns == [
        "atlas_name", "acres_abc", "acres_abc_per_year", "acres_abc_per_year_per_eu",
    ]


def test_unknown_names(spark):
    t = tables(spark)
    with pytest.raises(KeyError):
        query(t, S, "towns", "exp")
    with pytest.raises(KeyError):
        query(t, S, "states", "census")
    with pytest.raises(KeyError):
        study(t, S, "states", "nlcd")
    with pytest.raises(KeyError):
        t["roads"]
    with pytest.raises(KeyError):
        t.classes("nri", "4")


def test_checks(spark):
    tables(spark).check()
    zero = [("01001", "Adams", "North", "NO", 0.0, None)]
    with pytest.raises(InvalidTable, match="counties: acres_calc above zero"):
        tables(spark, counties=zero).check("counties")
    twice = [("N", "A", 1.0, None), ("M", "A", 1.0, None)]
    with pytest.raises(InvalidTable, match="states: unique st_abbrev"):
        tables(spark, states=twice).check("states")


def test_column_checks(spark):
    plain = frames(spark)
    with pytest.raises(InvalidTable, match="nri: column expansion is missing"):
        Tables.from_frames({"nri": plain["nri"].drop("expansion")})["nri"]
    labels_as_numbers = plain["nlcd_classes"].selectExpr("atlas_stco", "int(label) label", "acres")
    with pytest.raises(InvalidTable, match="nlcd_classes.label: int where string is due"):
        Tables.from_frames({"nlcd_classes": labels_as_numbers})["nlcd_classes"]
    exact = plain["nass"].selectExpr("atlas_stco", "cast(diff as decimal(18,2)) diff")
    assert Tables.from_frames({"nass": exact})["nass"].count() == 5


def test_hot_county_is_summed_whole(spark):
    """A third of all rows in one county: state sums stay whole and equal brute force."""
    rows = [("01001", "4", 1.0)] * 500 + [(c, "4", 2.0) for c in ("01003", "02001")] * 500
    got = by(query(tables(spark, nlcd_classes=rows), S, "states", "nlcd"), "atlas_name", "acres")
    assert got == {"North": 1500.0, "South": 1000.0}
