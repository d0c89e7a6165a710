"""Totals per zone, before they become rates.

A source is a study measure (``exp``, ``net``) or a dataset (``nlcd``, ``nri``,
``nass``). Each function returns a key column and ``total``.

County totals are summed before they meet a dimension table: the shuffle by
county is the one the join needs anyway, and only one row per county is left
for it. Joins carry no broadcast hint; Spark decides by size, at run time too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landcompare.config import Settings
from landcompare.sources.tables import Tables

SOURCES = ("exp", "net", "nlcd", "nri", "nass")


def county_rows(t: Tables, s: Settings, source: str, known: bool = False) -> DataFrame:
    """(atlas_stco, total), one row per row of the source table.

    ``known`` leaves out the rows of NRI and NASS that have no measure.
    """
    if source == "exp":
        return t.classes("study_classes", s.gain_label).select("atlas_stco", F.col("acres").alias("total"))
    if source == "net":
        return net(t, s)
    if source == "nlcd":
        return t.classes("nlcd_classes", s.nlcd_label).select("atlas_stco", F.col("acres").alias("total"))
    if source == "nri":
        rows = t.known("nri") if known else t["nri"]
        return rows.select("atlas_stco", F.col("expansion").alias("total"))
    if source == "nass":
        rows = t.known("nass") if known else t["nass"]
        return rows.select("atlas_stco", F.col("diff").alias("total"))
    raise KeyError(f"unknown source {source!r}; known: {', '.join(SOURCES)}")


def net(t: Tables, s: Settings) -> DataFrame:
    """Gain minus loss of the counties that have both classes, in one scan.

    Relies on (county, label) being unique, as ``Tables.check`` makes sure.
    """
    label, acres = F.col("label"), F.col("acres")
    gain, loss = label == s.gain_label, label == s.loss_label
    return (
        t.classes("study_classes", s.gain_label, s.loss_label)
        .groupBy("atlas_stco")
        .agg(
            F.sum(F.when(gain, acres)).alias("gain"),
            F.sum(F.when(loss, acres)).alias("loss"),
            F.count_if(gain).alias("gains"),
            F.count_if(loss).alias("losses"),
        )
        .where((F.col("gains") > 0) & (F.col("losses") > 0))
        .select("atlas_stco", (F.col("gain") - F.col("loss")).alias("total"))
    )


def net_by_self_join(t: Tables, s: Settings) -> DataFrame:
    """The same as a join of the two classes, which scans the histogram twice."""
    gain = t.classes("study_classes", s.gain_label).select("atlas_stco", F.col("acres").alias("gain"))
    loss = t.classes("study_classes", s.loss_label).select("atlas_stco", F.col("acres").alias("loss"))
    return gain.join(loss, "atlas_stco").select(
        "atlas_stco", (F.col("gain") - F.col("loss")).alias("total")
    )


def _sum(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("total").alias("total"))


def _county_sums(t: Tables, s: Settings, source: str) -> DataFrame:
    rows = county_rows(t, s, source)
    return rows if source == "net" else _sum(rows, "atlas_stco")  # net is summed already


def district_totals(t: Tables, s: Settings, source: str) -> DataFrame:
    """(district_unique, state_name, total); missing values count as nothing."""
    return _sum(
        _county_sums(t, s, source)
        .join(t["counties"].select("atlas_stco", "state_name"), "atlas_stco")
        .join(t["district_lookup"], F.col("atlas_stco") == F.col("fips")),
        "district_unique",
        "state_name",
    )


def state_totals(t: Tables, s: Settings, source: str) -> tuple[DataFrame, str]:
    """Totals per state and the key they come with: atlas_name or st_abbrev.

    The ways differ as the sources do: expansion is stored per state, NRI rows
    name their state, NLCD and NASS go through the county table (by name and by
    abbreviation), net change through the second county table.
    """
    if source == "exp":
        return t["study_states"].select("atlas_name", F.col("expansion").alias("total")), "atlas_name"
    if source == "nri":
        rows = t["nri"].select("st_abbrev", F.col("expansion").alias("total"))
        return _sum(rows, "st_abbrev"), "st_abbrev"
    if source == "nass":
        rows = county_rows(t, s, source, known=True)
        place = t["counties"].select("atlas_stco", "st_abbrev")
        return _sum(_sum(rows, "atlas_stco").join(place, "atlas_stco"), "st_abbrev"), "st_abbrev"
    place = t["county_states" if source == "net" else "counties"].select(
        "atlas_stco", F.col("state_name").alias("atlas_name")
    )
    return _sum(_county_sums(t, s, source).join(place, "atlas_stco"), "atlas_name"), "atlas_name"
