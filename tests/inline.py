"""Small logical tables with the awkward cases: one-sided counties, missing and
negative measures, a state without any, a county name found in two states."""

from landcompare.sources.schemas import SPECS
from landcompare.sources.tables import Tables

COUNTIES = [
    # stco, name, state, abbrev, area
    ("01001", "Adams", "North", "NO", 1000.0),
    ("01003", "Brown", "North", "NO", 2000.0),
    ("02001", "Adams", "South", "SO", 4000.0),
    ("02003", "Clark", "South", "SO", 500.0),
    ("03001", "Dixon", "West", "WE", 800.0),
]
STUDY = [
    ("01001", "3", 80.0),
    ("01001", "4", 16.0),
    ("01001", "5", 999.0),
    ("01003", "3", 40.0),
    ("02001", "4", 24.0),
    ("02003", "3", 8.0),
    ("02003", "4", 32.0),
    ("03001", "3", None),
    ("03001", "4", 8.0),
]
NLCD = [
    ("01001", "4", 160.0),
    ("01001", "3", 1.0),
    ("01003", "4", 8.0),
    ("02001", "4", 40.0),
    ("02003", "4", 0.0),
    ("03001", "4", 16.0),
]
NRI = [
    ("01001", "NO", 8.0),
    ("01003", "NO", None),
    ("02001", "SO", 16.0),
    ("02003", "SO", -8.0),
    ("03001", "WE", None),
]
NASS = [
    ("01001", 100.0),
    ("01003", None),
    ("02001", -50.0),
    ("02003", 20.0),
    ("03001", None),
]
DISTRICTS = [("01001", "N1"), ("01003", "N1"), ("02001", "S1"), ("02003", "S1"), ("03001", "W1")]


def frames(spark, **changed):
    area, state_area = {}, {}
    for stco, _, state, abbrev, acres in COUNTIES:
        district = dict(DISTRICTS)[stco]
        area[district] = area.get(district, 0) + acres
        state_area[state, abbrev] = state_area.get((state, abbrev), 0) + acres
    data = {
        "study_classes": STUDY,
        "study_states": [("North", 120.0), ("South", 8.0), ("West", None)],
        "nlcd_classes": NLCD,
        "nri": NRI,
        "nass": NASS,
        "counties": [(*c, f"g{c[0]}".encode()) for c in COUNTIES],
        "county_states": [(c[0], c[2]) for c in COUNTIES],
        "states": [(n, a, acres, n.encode()) for (n, a), acres in state_area.items()],
        "district_lookup": DISTRICTS,
        "district_areas": [(d, acres, d.encode()) for d, acres in area.items()],
    } | changed
    return {name: spark.createDataFrame(data[name], SPECS[name].schema) for name in data}


def tables(spark, **changed):
    return Tables.from_frames(frames(spark, **changed))


def by(frame, key, *columns):
    """Rows as a dict from key to the other columns (a value, or a tuple of them)."""
    got = {}
    for r in frame.collect():
        k = tuple(r[c] for c in key) if isinstance(key, tuple) else r[key]
        assert k not in got
        got[k] = r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)
    return got
