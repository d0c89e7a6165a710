"""All sources of a level in one row per zone, each table read once.

``wide`` gives the zone's key, area and geometry and per source ``total_<source>`` and
``rows_<source>``, the number of rows behind it. Facts of all sources are summed by
county in one aggregate, then join the dimensions once. States keep their separate ways:
expansion is stored per state, NRI rows name their state, net change goes through the
second county table, NLCD and NASS through the first, by name and by abbreviation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landcompare.config import Settings
from landcompare.sources.tables import Tables


def wide(t: Tables, s: Settings, level: str, sources: Sequence[str]) -> DataFrame:
    if t.load_wide:
        return t.load_wide(s, level, sources)
    return {"counties": _counties, "districts": _districts, "states": _states}[level](t, s, sources)


def present(level: str, source: str) -> Column:
    """Whether a zone has the source: by its rows, or where missing measures drop out by its total."""
    if (level, source) in (("counties", "nri"), ("states", "nass")):
        return F.col(f"total_{source}").isNotNull()
    return F.coalesce(F.col(f"rows_{source}"), F.lit(0)) > 0


def sums(sources: Sequence[str]) -> list[Column]:
    return [F.sum(f"{part}_{x}").alias(f"{part}_{x}") for x in sources for part in ("total", "rows")]


def study_sums(frame: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Expansion and net change from gain, loss and their numbers of rows; net change needs both."""
    both = (F.col("gains") > 0) & (F.col("losses") > 0)
    more = {}
    if "exp" in sources:
        more |= {"total_exp": F.col("gain"), "rows_exp": F.col("gains")}
    if "net" in sources:
        more |= {"total_net": F.when(both, F.col("gain") - F.col("loss")), "rows_net": both.cast("bigint")}
    return frame.withColumns(more).drop("gain", "gains", "loss", "losses")


def county_sums(t: Tables, s: Settings, sources: Sequence[str]) -> DataFrame:
    """(atlas_stco, totals and rows): facts of all sources in one aggregate, each table read once."""
    parts, aggregates = [], sums([x for x in sources if x not in ("exp", "net")])
    one = F.lit(1).cast("bigint")
    if {"exp", "net"} & set(sources):
        labels = [s.gain_label, s.loss_label] if "net" in sources else [s.gain_label]
        gain, loss = F.col("label") == s.gain_label, F.col("label") == s.loss_label
        classes = t.classes("study_classes", *labels)
        columns = {"gain": F.when(gain, F.col("acres")), "gains": F.when(gain, one), "loss": F.when(loss, F.col("acres")), "losses": F.when(loss, one)}
        parts.append(classes.select("atlas_stco", *[c.alias(n) for n, c in columns.items()]))
        aggregates += [F.sum(n).alias(n) for n in columns]
    facts = {
        "nlcd": lambda: t.classes("nlcd_classes", s.nlcd_label).select("atlas_stco", F.col("acres").alias("total_nlcd")),
        "nri": lambda: t["nri"].select("atlas_stco", F.col("expansion").alias("total_nri")),
        "nass": lambda: t["nass"].select("atlas_stco", F.col("diff").alias("total_nass")),
    }
    parts += [build().withColumn(f"rows_{x}", one) for x, build in facts.items() if x in sources]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return study_sums(whole.groupBy("atlas_stco").agg(*aggregates), sources)


def _counties(t: Tables, s: Settings, sources: Sequence[str]) -> DataFrame:
    zones = t["counties"].select("atlas_stco", F.col("acres_calc").cast("double").alias("acres_calc"), F.col("wkb_geometry").alias("geom"))
    return county_sums(t, s, sources).join(zones, "atlas_stco")


def _districts(t: Tables, s: Settings, sources: Sequence[str]) -> DataFrame:
    rows = (
        county_sums(t, s, sources)
        .join(t["counties"].select("atlas_stco", "state_name"), "atlas_stco")
        .join(t["district_lookup"], F.col("atlas_stco") == F.col("fips"))
        .groupBy("district_unique", "state_name")
        .agg(*sums(sources))
    )
    areas = t["district_areas"].select(F.col("STASD_A").alias("district_unique"), F.col("acres").cast("double").alias("acres"), "geom")
    return paired(rows, sources).join(areas, "district_unique")


def paired(rows: DataFrame, sources: Sequence[str]) -> DataFrame:
    """District sums of the study beside those of the datasets.

    Sums are by district and state, comparisons by district: where a district reaches into several states
    each of the study's rows meets each of a dataset's. There are as many parts as states.
    """
    columns = [c for c in rows.columns if c != "district_unique"]
    parts = rows.groupBy("district_unique").agg(F.collect_list(F.struct(*columns)).alias("parts"))
    both = parts.select("district_unique", F.explode("parts").alias("a"), "parts").select("district_unique", "a", F.explode("parts").alias("b"))
    side = {x: "a" if x in ("exp", "net") else "b" for x in sources}
    return both.select("district_unique", "a.state_name", *[F.col(f"{side[x]}.{p}_{x}").alias(f"{p}_{x}") for x in sources for p in ("total", "rows")])


def _states(t: Tables, s: Settings, sources: Sequence[str]) -> DataFrame:
    one, parts = F.lit(1).cast("bigint"), []

    def by(source: str, key: str) -> Column:
        return F.struct(F.lit(source).alias("source"), F.col(key).alias("key"), *[F.when(F.lit(source == x), F.col(f"{p}_{x}")).alias(f"{p}_{x}") for x in through for p in ("total", "rows")])

    through = [x for x in ("nlcd", "nass") if x in sources]
    if through:
        place = t["counties"].select("atlas_stco", "state_name", "st_abbrev")
        rows = county_sums(t, s, through).join(place, "atlas_stco").groupBy("state_name", "st_abbrev").agg(*sums(through))
        keyed = [by(x, "state_name" if x == "nlcd" else "st_abbrev") for x in through]
        parts.append(rows.select(F.inline(F.array(*keyed))))
    if "net" in sources:
        rows = county_sums(t, s, ["net"]).join(t["county_states"], "atlas_stco")
        parts.append(rows.where("rows_net > 0").select(F.lit("net").alias("source"), F.col("state_name").alias("key"), "total_net", "rows_net"))
    if "exp" in sources:
        parts.append(t["study_states"].select(F.lit("exp").alias("source"), F.col("atlas_name").alias("key"), F.col("expansion").alias("total_exp"), one.alias("rows_exp")))
    if "nri" in sources:
        parts.append(t["nri"].select(F.lit("nri").alias("source"), F.col("st_abbrev").alias("key"), F.col("expansion").alias("total_nri"), one.alias("rows_nri")))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("source", "key").agg(*sums(sources))
    names = {"exp": "atlas_name", "net": "atlas_name", "nlcd": "atlas_name", "nri": "st_abbrev", "nass": "st_abbrev"}
    keys = F.inline(F.array(*[F.struct(F.lit(x).alias("source"), F.col(names[x]).alias("key")) for x in sources]))
    states = t["states"].select("atlas_name", F.col("acres_calc").cast("double").alias("acres_calc"), F.col("wkb_geometry").alias("geom"))
    totals = t["states"].select("atlas_name", keys).join(whole, ["source", "key"]).groupBy("atlas_name").agg(*sums(sources))
    return totals.join(states, "atlas_name")
