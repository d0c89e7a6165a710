"""A session with the settings these plans like."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", checkpoints: str | None = None
) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster the submitter decides.

    ``checkpoints`` is the folder for scratch tables, where none is set.
    """
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    more = {"spark.checkpoint.dir": checkpoints} if checkpoints else {}
    return (
        SparkSession.builder.config(map=more)
        .master(f"local[{cores}]")
        .appName("landcompare")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Join by hash, without sorting, where every partition measured at run time is small.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call site per column
        .getOrCreate()
    )
