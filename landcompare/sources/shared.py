"""The folder all executors share, and tables there which cut a long lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str = "landcompare") -> str:
    """A new folder under ``spark.checkpoint.dir``, or where that is unset under the warehouse.

    Both are shared by driver and executors on a cluster; a machine's own temporary
    folder never is, so it is not used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The frame written once to the shared folder and read back.

    Cuts the lineage: a lost executor costs no recomputation of what is stored.
    """
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    frame.write.parquet(path, compression=compression)
    return spark.read.schema(frame.schema).parquet(path)


def dealt(frame: DataFrame, rows: int = 5_000) -> DataFrame:
    """The frame in tasks of so many rows: for rows that take few bytes in a file, which is read by few tasks, but much time each."""
    return frame.repartition(max(1, -(-frame.count() // rows)))
