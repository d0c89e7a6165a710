"""Hot keys and gaps: a third of the orders in one county, a third of the lines in
one order, counties without orders, missing amounts. Queries must equal their twins."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from test_oracle import rows

SMALL = "/root/testdata/sf0.001"
NAMES = ("region", "nation", "customer", "orders", "lineitem")
CHOSEN = [
    n
    for n in oracle_sql()
    if n.startswith(("counties_", "districts_", "states_", "compare_counties_n", "fits_", "profiles_states"))
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE TABLE {n} AS SELECT * FROM '{SMALL}/{n}.parquet'")
    con.execute("UPDATE orders SET o_custkey = 7 WHERE o_orderkey % 3 = 0")
    con.execute("UPDATE lineitem SET l_orderkey = 5 WHERE l_linenumber % 3 = 0")
    con.execute("DELETE FROM orders WHERE o_custkey BETWEEN 20 AND 30")
    con.execute("UPDATE orders SET o_totalprice = NULL WHERE o_custkey BETWEEN 40 AND 44 AND o_orderstatus <> 'O'")
    con.execute("UPDATE lineitem SET l_extendedprice = NULL WHERE l_returnflag = 'R' AND l_orderkey % 50 = 1")
    for n in NAMES:
        con.execute(f"COPY {n} TO '{folder}/{n}.parquet'")
    share = "SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM {} GROUP BY {})"
    for table, key in (("orders", "o_custkey"), ("lineitem", "l_orderkey")):
        assert con.execute(share.format(table, key)).fetchall()[0][0] > 0.25
    return con, str(folder)


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_twin_on_skewed_data(spark, skewed, name):
    con, folder = skewed
    frame = queries()[name](spark, folder)
    result = con.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = rows(columns, result.fetchall())
    assert want
    assert rows(frame.columns, frame.collect()) == want
