"""Every catalogue query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from hornspark import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_parity(spark, tables, name):
    df = catalogue.run_query(spark, DATA, name)
    found = tables.execute(catalogue.oracle_sql()[name])
    assert df.columns == [c[0] for c in found.description]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_self_join_over_all_suppliers(spark):
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect()
    orders = {}
    for o, s in rows:
        orders.setdefault(o, set()).add(s)
    got = catalogue.run_query(spark, DATA, "self_join_all").collect()
    assert sorted(map(tuple, got)) == sorted({(s, t) for found in orders.values() for s in found for t in found})
