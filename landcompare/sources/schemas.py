"""The ten logical tables: columns, keys, and the checks to run at load.

Measures are DOUBLE; a DECIMAL column is accepted too and keeps sums exact, and whole
numbers become DECIMAL. Geometry is WKB, as bytes or as hex text, and only carried.
``problems`` counts repeated and NULL keys and areas that are NULL, NaN or not above
zero. Tables derived from orders leave the area of a county without orders NULL: such a
county breaks the rule, as it has no share.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    schema: T.StructType
    keys: tuple[tuple[str, ...], ...]  # each unique
    area: str | None = None  # must be above zero


def _schema(**columns: str) -> T.StructType:
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in columns.items()])


SPECS: dict[str, TableSpec] = {
    # acres per county and class label of the study
    "study_classes": TableSpec(
        _schema(atlas_stco="string", label="string", acres="double"), (("atlas_stco", "label"),)
    ),
    # expansion of the study, already per state
    "study_states": TableSpec(_schema(atlas_name="string", expansion="double"), (("atlas_name",),)),
    "nlcd_classes": TableSpec(
        _schema(atlas_stco="string", label="string", acres="double"), (("atlas_stco", "label"),)
    ),
    "nri": TableSpec(
        _schema(atlas_stco="string", st_abbrev="string", expansion="double"), (("atlas_stco",),)
    ),
    "nass": TableSpec(_schema(atlas_stco="string", diff="double"), (("atlas_stco",),)),
    "counties": TableSpec(
        _schema(
            atlas_stco="string",
            atlas_name="string",
            state_name="string",
            st_abbrev="string",
            acres_calc="double",
            wkb_geometry="binary",
        ),
        (("atlas_stco",),),
        "acres_calc",
    ),
    # a second county table, which only says the state
    "county_states": TableSpec(_schema(atlas_stco="string", state_name="string"), (("atlas_stco",),)),
    "states": TableSpec(
        _schema(atlas_name="string", st_abbrev="string", acres_calc="double", wkb_geometry="binary"),
        (("atlas_name",), ("st_abbrev",)),
        "acres_calc",
    ),
    "district_lookup": TableSpec(_schema(fips="string", district_unique="string"), (("fips",),)),
    "district_areas": TableSpec(
        _schema(STASD_A="string", acres="double", geom="binary"), (("STASD_A",),), "acres"
    ),
}


class InvalidTable(ValueError):
    """A logical table breaks its contract."""


def check_columns(name: str, frame: DataFrame) -> DataFrame:
    """The frame cut to the table's columns, whole numbers and hex text converted; raises if one is missing or mistyped."""
    columns = []
    for want in SPECS[name].schema:
        if want.name not in frame.columns:
            raise InvalidTable(f"{name}: column {want.name} is missing")
        have, column = frame.schema[want.name].dataType, F.col(want.name)
        if isinstance(want.dataType, T.DoubleType) and isinstance(have, T.IntegralType):
            column = column.cast("decimal(20,0)").alias(want.name)
        elif isinstance(want.dataType, T.BinaryType) and isinstance(have, T.StringType):
            column = F.unhex(column).alias(want.name)
        elif have != want.dataType and not (isinstance(want.dataType, T.DoubleType) and isinstance(have, T.NumericType)):
            raise InvalidTable(
                f"{name}.{want.name}: {have.simpleString()} where {want.dataType.simpleString()} is due"
            )
        columns.append(column)
    return frame.select(*columns)


def problems(name: str, frame: DataFrame) -> DataFrame:
    """(table, rule, n): how many keys or rows break a rule. One row per rule."""
    spec = SPECS[name]
    checks = [
        frame.groupBy(*key)
        .count()
        .agg(F.count_if(F.col("count") > 1).alias("n"))
        .select(F.lit(name).alias("table"), F.lit(f"unique {', '.join(key)}").alias("rule"), "n")
        for key in spec.keys
    ]
    rules = {f"{column} not NULL": F.col(column).isNull() for key in spec.keys for column in key}
    if spec.area:
        area = F.col(spec.area)
        rules[f"{spec.area} above zero"] = area.isNull() | F.isnan(area.cast("double")) | (area <= 0)
    counts = frame.agg(*[F.count_if(broken).alias(f"n{k}") for k, broken in enumerate(rules.values())])
    rows = [F.struct(F.lit(name).alias("table"), F.lit(rule).alias("rule"), F.col(f"n{k}").alias("n")) for k, rule in enumerate(rules)]
    checks.append(counts.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, checks)
