"""The study joined with a comparison dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landcompare.config import Dataset, Settings
from landcompare.functions.expressions import annual, log1p, percent_of_area, safe_ratio
from landcompare.operators.choropleth import by_map, map_values, saturate
from landcompare.operators.fit import fit
from landcompare.operators.hexbins import BINS, hexbins
from landcompare.operators.profile import DERIVED, profile
from landcompare.operators.queries import columns, measured, query, share_of_district, study
from landcompare.operators.wide import present, wide
from landcompare.sources.tables import Tables

# The column that identifies a zone.
ZONE_KEYS = {"counties": "atlas_stco", "districts": "district_unique", "states": "atlas_name"}


def compare(
    t: Tables, s: Settings, level: str, dataset: str, map_name: str | None = None, on: str | None = None
) -> DataFrame:
    """Zones known to both sides, with rates, shares and their differences.

    ``diff_acres`` is the dataset's share minus the study's, in percentage
    points; ``diff_ratio`` is that relative to the study's share. A map name
    adds ``col_sat``. ``on`` joins the two query results by another column: by
    ``atlas_name``, counties of the same name in two states match each other.
    """
    d = s.dataset(level, dataset)
    if on and on != ZONE_KEYS[level]:
        frame = _joined(study(t, s, level, d.study), query(t, s, level, d.query), on)
    elif level == "districts":
        frame = side_by_side(wide(t, s, level, [d.study, d.query]), s, level, {dataset: d})
        frame = frame.select("district_unique", "state_name", s.rate(d.study), "acres", "geom", s.share(d.study), s.rate(d.query))
    else:
        both = dict.fromkeys(columns(s, level, d.study) + columns(s, level, d.query))
        frame = measured(t, s, level, [d.study, d.query]).select(*both)
    frame = differences(frame, s, level, d.study)
    return saturate(frame, s.map(level, map_name)) if map_name else frame


def side_by_side(frame: DataFrame, s: Settings, level: str, datasets: Mapping[str, Dataset]) -> DataFrame:
    """A row per zone and dataset that both sides know, with rates and shares, from a wide frame."""

    def side(d: Dataset) -> list[Column]:
        pairs = [("study_", d.study), ("", d.query)]
        return [
            c
            for prefix, x in pairs
            for c in (F.col(f"total_{x}").cast("double").alias(f"{prefix}total"), F.lit(s.years[x]).alias(f"{prefix}years"))
        ]

    parts = [
        F.struct(F.lit(name).alias("dataset"), *side(d), (present(level, d.study) & present(level, d.query)).alias("there"))
        for name, d in datasets.items()
    ]
    zone = [c for c in frame.columns if not c.startswith(("total_", "rows_"))]
    rows = frame.select(*zone, F.inline(F.array(*parts))).where("there")
    rates = {s.rate("exp"): annual(F.col("study_total"), F.col("study_years")), s.rate("nri"): annual(F.col("total"), F.col("years"))}
    rows = rows.withColumns(rates)
    percent = share_of_district if level == "districts" else lambda rate: percent_of_area(rate, F.col("acres_calc"))
    shares = {s.share(x): percent(F.col(s.rate(x))) for x in ("exp", "nri")}
    return rows.withColumns(shares).drop("study_total", "study_years", "total", "years", "there")


def _joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that keeps the left side's columns where names repeat.

    A repeated zone key is kept too, as ``<key>_comparison``.
    """
    for name in set(left.columns) & set(right.columns) - {key}:
        if name in ZONE_KEYS.values():
            right = right.withColumnRenamed(name, f"{name}_comparison")
        else:
            right = right.drop(name)
    return left.join(right, key)


def differences(frame: DataFrame, s: Settings, level: str, kind: str) -> DataFrame:
    rate, share = "acres_per_year", "acres_per_year_per_eu"
    study_rate, study_share = s.rate(kind), s.share(kind)
    if level == "districts":
        frame = frame.withColumn(share, share_of_district(F.col(rate)))
    frame = frame.withColumn("diff_acres", F.col(share) - F.col(study_share)).withColumn(
        "diff_ratio", safe_ratio(F.col("diff_acres"), F.col(study_share))
    )
    if s.level(level).log_columns:
        frame = frame.withColumns({"x_log1p": log1p(F.col(study_rate)), "y_log1p": log1p(F.col(rate))})
    return frame


def common_columns(s: Settings, level: str) -> list[str]:
    """Columns every comparison of a level has."""
    logs = ["x_log1p", "y_log1p"] if s.level(level).log_columns else []
    return [
        s.rate("exp"),
        s.share("exp"),
        s.rate("nri"),
        s.share("nri"),
        "diff_acres",
        "diff_ratio",
        *logs,
        "geom",
    ]


def long_frame(frames: Mapping[str, DataFrame], s: Settings, level: str) -> DataFrame:
    """Comparison frames by dataset as one: level, dataset, zone and the common figures."""
    zone = F.col(ZONE_KEYS[level]).alias("zone")
    parts = [
        frame.select(F.lit(level).alias("level"), F.lit(name).alias("dataset"), zone, *common_columns(s, level))
        for name, frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def comparisons(t: Tables, s: Settings, level: str) -> DataFrame:
    """All datasets of a level in one long frame, from one pass over the tables."""
    datasets = s.level(level).datasets
    sources = dict.fromkeys(x for d in datasets.values() for x in (d.study, d.query))
    rows = differences(side_by_side(wide(t, s, level, list(sources)), s, level, datasets), s, level, "exp")
    zone = F.col(ZONE_KEYS[level]).alias("zone")
    return rows.select(F.lit(level).alias("level"), "dataset", zone, *common_columns(s, level))


def comparisons_by_map(long: DataFrame, s: Settings, level: str, maps: Sequence[str] = ()) -> DataFrame:
    """The long frame with a row per map and its clamped column."""
    return by_map(long, {m: s.map(level, m) for m in maps or s.level(level).drawn})


def choropleth(long: DataFrame, s: Settings, level: str, maps: Sequence[str] = ()) -> DataFrame:
    """(level, dataset, zone, map, col_sat, fill_pos, geom)."""
    specs = {m: s.map(level, m) for m in maps or s.level(level).drawn}
    return map_values(long, specs, "level", "dataset", "zone")


def fits(long: DataFrame, s: Settings, level: str) -> DataFrame:
    """Per dataset the scatter statistics, each in the dataset's own space."""
    return fit(long, s.rate("exp"), s.rate("nri"), _spaces(s, level), by=("level", "dataset"))


def hexagons(long: DataFrame, s: Settings, level: str, bins: int = BINS) -> DataFrame:
    """Per dataset the scatter plot's points counted by hexagons, each in the dataset's own space."""
    return hexbins(long, s.rate("exp"), s.rate("nri"), _spaces(s, level), ("level", "dataset"), bins)


def _spaces(s: Settings, level: str) -> Column:
    return F.coalesce(*[F.when(F.col("dataset") == n, F.lit(d.transform)) for n, d in s.level(level).datasets.items()])


def scatter_fits(long: DataFrame, s: Settings, level: str) -> DataFrame:
    """Per dataset, scatter plot of the level's description and transform the scatter statistics."""
    kinds = [
        F.struct(
            F.lit(name).alias("scatter"),
            F.lit({"no_log": "identity"}.get(trans, trans)).alias("space"),
            F.col(plot.x).cast("double").alias("x"),
            F.col(plot.y).cast("double").alias("y"),
        )
        for name, plot in s.level(level).scatterplots.items()
        for trans in plot.log_trans or ("no_log",)
    ]
    rows = long.select("level", "dataset", F.inline(F.array(*kinds)))
    return fit(rows, "x", "y", F.col("space"), by=("level", "dataset", "scatter"))


def profiles(long: DataFrame, s: Settings, level: str) -> DataFrame:
    """Per dataset the ranges of shares and derived columns."""
    wanted = [s.share("exp"), s.share("nri"), *[c for c in DERIVED if c in long.columns]]
    return profile(long, wanted, by=("level", "dataset"))
