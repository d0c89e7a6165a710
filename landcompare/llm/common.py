"""What several operators need: tables, scratch tables, clash-free rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landcompare.sources.shared import stored  # noqa: F401  the operators take it from here


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256):
    """Rows that hold whole texts or sets reach Python in batches of few, for jobs that run within the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Memory that a Python worker has freed goes back to the system: workers outlive their tasks, and their allocators keep what they once had."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # only glibc has it


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for tasks on batches, which gives memory back as it ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


TEXTS = 200  # that are Python strings at a time


def few(batches: Iterator, rows: int = TEXTS) -> Iterator:
    """The batches in slices of so many rows, so that few texts are copied at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id BIGINT, text STRING, null as empty) and nothing else, so no other column can clash."""
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """(row STRUCT of all columns, doc_id, text): unpack with ``select("row.*")``."""
    rows = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return rows.select("row", F.col("row.doc_id").cast("bigint").alias("doc_id"), text.alias("text"))


def digest(text: Column) -> Column:
    """32 bytes which stand for a text."""
    return F.unhex(F.sha2(text, 256))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
