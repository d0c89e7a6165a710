"""Reading logical tables from a relational data base.

Address and login come from the caller (a secret store, never this code).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import pairwise

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from landcompare.sources.schemas import SPECS
from landcompare.sources.tables import Tables

# The column by which each large table is read in parallel.
SPLIT_COLUMNS = {
    "study_classes": "atlas_stco",
    "nlcd_classes": "atlas_stco",
    "nri": "atlas_stco",
    "nass": "atlas_stco",
    "counties": "atlas_stco",
    "county_states": "atlas_stco",
    "district_lookup": "fips",
}


def split_predicates(column: str, bounds: Sequence[str]) -> list[str]:
    """One WHERE clause per task: ranges of the key between ascending bounds, NULL keys in the first."""
    texts = ["'" + b.replace("'", "''") + "'" for b in dict.fromkeys(bounds)]
    if not texts:
        return ["true"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in pairwise(texts)]
    return [f"{column} < {texts[0]} OR {column} IS NULL", *inner, f"{column} >= {texts[-1]}"]


def bounds_query(relation: str, column: str, parts: int) -> str:
    """A relation (bound): the keys that cut a table into parts of equal size, by one pass on the server."""
    shares = ", ".join(f"{k}/{parts}.0" for k in range(1, parts))
    return f"(SELECT unnest(percentile_disc(ARRAY[{shares}]) WITHIN GROUP (ORDER BY {column})) AS bound FROM {relation}) b"


def relation_of(name: str, relation: str) -> str:
    """What to read for a table: its columns, geometry as WKB."""
    columns = [f"ST_AsBinary({f.name}) AS {f.name}" if isinstance(f.dataType, T.BinaryType) else f'"{f.name}"' for f in SPECS[name].schema]
    return f"(SELECT {', '.join(columns)} FROM {relation}) q"


def jdbc_tables(
    spark: SparkSession,
    url: str | Mapping[str, str],
    names: Mapping[str, str],
    properties: Mapping[str, str],
    parts: int = 64,
    bounds: Mapping[str, Sequence[str]] | None = None,
) -> Tables:
    """Tables of PostgreSQL data bases; ``names`` maps logical to data base names.

    ``url`` is one address, or one per logical name. Large tables are read in ``parts`` key ranges, between
    the ``bounds`` given for a table or those the server finds. Each task reads its range only; with an index
    on the key the server does too.
    """

    def load(name: str):
        address = url if isinstance(url, str) else url[name]
        column, relation = SPLIT_COLUMNS.get(name), relation_of(name, names[name])
        if column is None or parts < 2:
            return spark.read.jdbc(address, relation, properties=dict(properties))
        cuts = (bounds or {}).get(name)
        if cuts is None:
            rows = spark.read.jdbc(address, bounds_query(names[name], column, parts), properties=dict(properties))
            cuts = [r.bound for r in rows.orderBy("bound").collect() if r.bound is not None]  # parts - 1 at most
        return spark.read.jdbc(address, relation, predicates=split_predicates(column, cuts), properties=dict(properties))

    return Tables(load)
