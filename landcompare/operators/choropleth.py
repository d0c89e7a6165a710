"""Map values: one row per zone and map."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landcompare.config import MapSpec
from landcompare.functions.expressions import clamp, fill_position


def column_of(frame: DataFrame, spec: MapSpec) -> str:
    if spec.column not in frame.columns:
        raise ValueError(f"map column {spec.column!r} is not among {', '.join(frame.columns)}")
    return spec.column


def saturate(frame: DataFrame, spec: MapSpec) -> DataFrame:
    """Adds ``col_sat``: the map's column, clamped to its limit."""
    return frame.withColumn("col_sat", clamp(F.col(column_of(frame, spec)), spec.sat))


def by_map(frame: DataFrame, maps: Mapping[str, MapSpec]) -> DataFrame:
    """Every row once per map, with ``map``, ``sat`` and ``col_sat``.

    All maps come from one evaluation of the frame.
    """
    values = [
        F.struct(
            F.lit(name).alias("map"),
            F.lit(float(spec.sat)).alias("sat"),
            clamp(F.col(column_of(frame, spec)), spec.sat).alias("col_sat"),
        )
        for name, spec in maps.items()
    ]
    return frame.select("*", F.inline(F.array(*values)))


def map_values(frame: DataFrame, maps: Mapping[str, MapSpec], *zone: str) -> DataFrame:
    """The zone's columns with map, col_sat, fill_pos and geom, for each map."""
    return by_map(frame, maps).select(
        *zone, "map", "col_sat", fill_position(F.col("col_sat"), F.col("sat")).alias("fill_pos"), "geom"
    )
