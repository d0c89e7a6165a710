"""Registered queries against their SQL twins in DuckDB."""

import duckdb
import pytest
from test_oracle import rows

from landcompare.llm import registry


@pytest.mark.parametrize("name", registry.oracle_sql())
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_twin(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for n in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    frame = registry.queries()[name](spark, folder)
    assert rows(frame.columns, frame.collect()) == rows(columns, result.fetchall())


def test_names():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 14)]
