"""CSV and Parquet results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drop_geometry(frame: DataFrame) -> DataFrame:
    """The frame without its binary columns."""
    return frame.drop(*[f.name for f in frame.schema if isinstance(f.dataType, T.BinaryType)])


def _text(field: T.StructField):
    c = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        c = (
            F.when(c == float("inf"), F.lit("Inf"))
            .when(c == -float("inf"), F.lit("-Inf"))
            .otherwise(c.cast("string"))
        )
    return c.alias(field.name)


def write_csv(frame: DataFrame, path: str) -> None:
    """CSV parts with header; missing values are NA, infinite ones Inf and -Inf.

    A row number is not written: it has no meaning on a distributed frame.
    """
    flat = drop_geometry(frame)
    flat.select(*[_text(f) for f in flat.schema]).write.mode("overwrite").csv(
        path, header=True, nullValue="NA", emptyValue=""
    )


def csv_path(folder: str, level: str, dataset: str, map_name: str, kind: str) -> str:
    """Level and map are part of the name, so no result overwrites another."""
    return f"{folder}/{level}/{dataset}_{map_name}_{kind}.csv"
