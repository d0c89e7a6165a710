"""All results of a level, written to a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landcompare.config import Settings
from landcompare.operators.choropleth import saturate
from landcompare.operators.fit import axis_labels
from landcompare.plans.compare import choropleth, compare, fits, long_frame, profiles
from landcompare.sources.sinks import csv_path, write_csv
from landcompare.sources.tables import Tables


def report(
    spark: SparkSession, t: Tables, s: Settings, level: str, folder: str, check: bool = True
) -> dict[str, DataFrame]:
    """Compare every dataset of a level and write what follows from it.

    Below ``folder/level``: a ``_raw`` CSV per dataset and map, at levels with log
    columns a ``_qaqc`` CSV of ranges, and as Parquet ``frames/<dataset>``,
    ``profiles``, ``choropleth`` and ``fits``. Each comparison is computed once and written;
    all else reads it back, so a lost executor costs no second computation.
    Returns the written frames by name.
    """
    if check:
        t.check()
    target = f"{folder}/{level}"
    plan = s.level(level)
    frames = {}
    for name in plan.datasets:
        path = f"{target}/frames/{name}"
        compare(t, s, level, name).write.mode("overwrite").parquet(path)
        frames[name] = spark.read.parquet(path)
    for name, frame in frames.items():
        for m in plan.drawn:
            write_csv(saturate(frame, s.map(level, m)), csv_path(folder, level, name, m, "raw"))
    long = long_frame(frames, s, level)
    if plan.log_columns:
        profiles(long, s, level).write.mode("overwrite").parquet(f"{target}/profiles")
        ranges = spark.read.parquet(f"{target}/profiles")
        for name in frames:
            own = ranges.where(ranges["dataset"] == name).drop("level", "dataset")
            for m in plan.drawn:  # the profiled columns are the same for every map
                write_csv(own, csv_path(folder, level, name, m, "qaqc"))
    results = {"choropleth": choropleth(long, s, level), "fits": axis_labels(fits(long, s, level))}
    for name, frame in results.items():
        frame.write.mode("overwrite").parquet(f"{target}/{name}")
    return frames | {name: spark.read.parquet(f"{target}/{name}") for name in results}
