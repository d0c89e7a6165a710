"""The fifteen named queries: five sources at three levels.

Rates are per year, shares percent of the zone's area per year. Area and
geometry join last, after every sum, so geometry is in no aggregate's shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landcompare.config import LEVELS, Settings
from landcompare.functions.expressions import annual, percent_of_area, safe_ratio
from landcompare.operators.totals import SOURCES, county_rows, district_totals, state_totals
from landcompare.sources.tables import Tables

STUDY = ("exp", "net")


def query(t: Tables, s: Settings, level: str, source: str) -> DataFrame:
    """One of the named queries, e.g. ``query(t, s, "states", "nlcd")``."""
    if level not in LEVELS or source not in SOURCES:
        raise KeyError(f"no query {source!r} at level {level!r}")
    if level == "districts":
        frame = district_rates(t, s, source)
        return frame.orderBy("state_name") if source == "nass" else frame
    return measured(t, s, level, [source]).select(*columns(s, level, source))


def district_rates(t: Tables, s: Settings, source: str) -> DataFrame:
    """(district_unique, state_name, rate); the sums have no area at this level."""
    return district_totals(t, s, source).select(
        "district_unique", "state_name", annual(F.col("total"), s.years[source]).alias(s.rate(source))
    )


def measured(t: Tables, s: Settings, level: str, sources: Sequence[str]) -> DataFrame:
    """Counties or states with total, rate and share of one or more sources.

    Zones missing from a source drop out. The zone table joins once, however
    many sources there are.
    """
    frame = _zones(t, level)
    for source in sources:
        totals, key = _totals(t, s, level, source)
        frame = frame.join(totals.withColumnRenamed("total", f"total_{source}"), key)
    return with_rates(frame, s, sources)


def with_rates(frame: DataFrame, s: Settings, sources: Sequence[str]) -> DataFrame:
    """Adds total, rate and share from ``total_<source>`` and ``acres_calc``."""
    rates = {s.rate(x): annual(F.col(f"total_{x}"), s.years[x]) for x in sources}
    shares = {s.share(x): percent_of_area(F.col(s.rate(x)), F.col("acres_calc")) for x in sources}
    totals = {_total(s, x): F.col(f"total_{x}").cast("double") for x in sources}
    return frame.withColumns(rates | totals).withColumns(shares)


def _zones(t: Tables, level: str) -> DataFrame:
    zones = t["counties"].select("atlas_stco", "atlas_name", "acres_calc", "wkb_geometry")
    if level == "states":
        zones = t["states"]
    return zones.withColumnRenamed("wkb_geometry", "geom").withColumn(
        "acres_calc", F.col("acres_calc").cast("double")
    )


def _totals(t: Tables, s: Settings, level: str, source: str) -> tuple[DataFrame, str]:
    if level == "states":
        return state_totals(t, s, source)
    return county_rows(t, s, source, known=source == "nri"), "atlas_stco"


def _total(s: Settings, source: str) -> str:
    return f"acres_{s.study_tag}" if source in STUDY else "acres"


def columns(s: Settings, level: str, source: str) -> list[str]:
    """Output columns of a county or state query."""
    zone = ["atlas_stco", "atlas_name"] if level == "counties" else ["atlas_name"]
    figures = [s.rate(source), s.share(source)]
    if source in ("nlcd", "nri") or (level, source) == ("states", "exp"):
        figures = [_total(s, source), *figures]
    if source in STUDY:
        return zone + figures
    return zone + figures + (["acres_calc", "geom"] if level == "counties" else ["geom"])


def study(t: Tables, s: Settings, level: str, kind: str) -> DataFrame:
    """The study's frame: a named query, at district level joined with the district areas."""
    if kind not in STUDY:
        raise KeyError(f"unknown study measure {kind!r}; known: {', '.join(STUDY)}")
    if level != "districts":
        return query(t, s, level, kind)
    areas = t["district_areas"].withColumnRenamed("STASD_A", "district_unique")
    return (
        district_rates(t, s, kind)
        .join(areas, "district_unique")
        .withColumn("acres", F.col("acres").cast("double"))
        .withColumn(s.share(kind), share_of_district(F.col(s.rate(kind))))
    )


def share_of_district(rate: Column) -> Column:
    return safe_ratio(rate, F.col("acres")) * 100
