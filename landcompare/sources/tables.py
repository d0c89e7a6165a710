"""Access to the logical tables, stored or derived."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landcompare.sources.schemas import SPECS, InvalidTable, check_columns, problems

HISTOGRAMS = ("study_classes", "nlcd_classes")
MEASURES = {"nri": "expansion", "nass": "diff"}  # may be missing


class Tables:
    """The logical tables by name, loaded on first use.

    ``load`` maps a table name to its frame. A source which derives tables may add
    ``load_classes``, which builds a class histogram for some labels only, and
    ``load_known``, which builds a table without the rows that lack a measure: so
    it can filter at its own scans. Otherwise the filters go on the loaded frame,
    where Catalyst pushes them into the scan or prunes partitions by them.
    ``load_wide`` may build all sources of a level in one pass (``operators.wide``).
    """

    def __init__(
        self,
        load: Callable[[str], DataFrame],
        load_classes: Callable[[str, Sequence[str]], DataFrame] | None = None,
        load_known: Callable[[str], DataFrame] | None = None,
        load_wide: Callable[..., DataFrame] | None = None,
    ):
        self._load = load
        self._load_classes = load_classes
        self._load_known = load_known
        self.load_wide = load_wide
        self._frames: dict[object, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SPECS:
            raise KeyError(f"unknown table {name!r}; known: {', '.join(SPECS)}")
        return self._once(name, name, self._load)

    def _once(self, key, name: str, build: Callable[..., DataFrame], *args) -> DataFrame:
        if key not in self._frames:
            self._frames[key] = check_columns(name, build(name, *args))
        return self._frames[key]

    def classes(self, name: str, *labels: str) -> DataFrame:
        """Rows of a class histogram with one of the labels."""
        if name not in HISTOGRAMS:
            raise KeyError(f"{name!r} is no class histogram")
        if self._load_classes:
            return self._once((name, *labels), name, self._load_classes, labels)
        return self[name].where(F.col("label").isin(*labels))

    def known(self, name: str) -> DataFrame:
        """Rows of a table whose measure is not missing."""
        if name not in MEASURES:
            raise KeyError(f"{name!r} has no measure that may be missing")
        frame = self._once((name, None), name, self._load_known) if self._load_known else self[name]
        return frame.where(F.col(MEASURES[name]).isNotNull())

    def check(self, *names: str) -> None:
        """Raise InvalidTable if keys repeat or areas are not positive."""
        found = reduce(DataFrame.unionByName, [problems(n, self[n]) for n in names or SPECS])
        bad = found.where(F.col("n") > 0).collect()  # one row per rule
        if bad:
            raise InvalidTable("; ".join(f"{r.table}: {r.rule} broken {r.n} times" for r in bad))

    # -- sources ---------------------------------------------------------------

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> Tables:
        return cls(lambda name: frames[name])

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> Tables:
        """Tables stored one per folder, as ``save_parquet`` leaves them."""

        def load(name: str) -> DataFrame:
            frame = spark.read.parquet(f"{folder}/{name}")
            if name not in HISTOGRAMS:
                return frame
            # A label read from a folder name would be taken for a number.
            texts = [
                T.StructField(f.name, T.StringType() if f.name == "label" else f.dataType)
                for f in frame.schema
            ]
            return spark.read.schema(T.StructType(texts)).parquet(f"{folder}/{name}")

        return cls(load)

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: Mapping[str, str]) -> Tables:
        """Tables of the session catalog; ``names`` maps logical to catalog names."""
        return cls(lambda name: spark.table(names.get(name, name)))

    # -- sinks -----------------------------------------------------------------

    def save_parquet(self, folder: str, *names: str) -> None:
        """Store tables as Parquet, histograms partitioned by class label."""
        for name in names or SPECS:
            frame = self[name]
            if name in HISTOGRAMS:
                # By label and, against a hot label, by Spark's choice of size.
                frame.hint("rebalance", "label").write.mode("overwrite").partitionBy("label").parquet(f"{folder}/{name}")
            else:
                frame.write.mode("overwrite").parquet(f"{folder}/{name}")

    def save_bucketed(self, names: Mapping[str, str], buckets: int) -> None:
        """Store tables in the catalog, county tables bucketed and sorted by county.

        Joins of county tables then need no shuffle, whatever their size.
        ``names`` maps logical to catalog names and picks what is stored.
        """
        for name, target in names.items():
            frame = self[name]
            key = {"district_lookup": "fips"}.get(name, "atlas_stco")
            if key in frame.columns:
                # Dealt by bucket first: one file per bucket, however many tasks.
                writer = frame.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
            else:
                writer = frame.write
            writer.mode("overwrite").format("parquet").saveAsTable(target)

    def register(self, names: Mapping[str, str] | None = None) -> None:
        """Make the tables visible to SQL as temporary views."""
        for name, view in (names or {n: n for n in SPECS}).items():
            self[name].createOrReplaceTempView(view)
