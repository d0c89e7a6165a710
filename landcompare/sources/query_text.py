"""Running query files kept as SQL text, one folder per level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def whole_text(spark: SparkSession, path: str) -> str:
    """Text of the one file that the path names."""
    rows = spark.read.text(path, wholetext=True).take(2)
    if len(rows) != 1:
        raise ValueError(f"{path} should name one file, not {'none' if not rows else 'several'}")
    return rows[0].value


def read_query(spark: SparkSession, folder: str, level: str, query: str) -> str:
    """Text of ``<folder>/<level>/query_<query>.sql`` on any file system Spark reads."""
    return whole_text(spark, f"{folder}/{level}/query_{query}.sql").rstrip().rstrip(";")


def run_query(
    spark: SparkSession, folder: str, level: str, query: str, args: dict | None = None
) -> DataFrame:
    """The query's frame over the tables or views its text names."""
    return spark.sql(read_query(spark, folder, level, query), args=args)
