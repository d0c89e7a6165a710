"""Every registered query against its SQL twin, over whole tables."""

import math
import os

import duckdb
import pytest

import sql_twins
from __spark_entry__ import entry, oracle_sql, queries

NAMES = "region nation customer supplier part orders lineitem".split()
FOLDERS = [f"/root/testdata/sf{x}" for x in os.environ.get("ORACLE_SF", "0.001").split(",")]
TWINS = {name: sql for name, sql in oracle_sql().items() if name in sql_twins.oracle_sql()}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module", params=FOLDERS)
def case(request):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{request.param}/{n}.parquet'")
    return con, request.param


def test_every_query_has_a_twin():
    others = {name for name in queries() if name == "pipeline" or name.startswith("op")}
    assert set(queries()) - others == set(TWINS)


@pytest.mark.parametrize("name", list(TWINS))
def test_matches_twin(spark, case, name):
    con, folder = case
    frame = queries()[name](spark, folder)
    result = con.execute(TWINS[name])
    columns = [d[0] for d in result.description]
    kinds = {"VARCHAR": "string", "DOUBLE": "double", "BIGINT": "bigint"}
    assert dict(frame.dtypes) == {d[0]: kinds[str(d[1])] for d in result.description}
    want = rows(columns, result.fetchall())
    assert want
    assert rows(frame.columns, frame.collect()) == want


def test_entry_runs(spark):
    assert entry(spark).count() == 5
