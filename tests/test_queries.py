"""Every registered query against its SQL on the smallest driver tables."""

import glob
import math
import os

import duckdb
import pytest

from factloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not there")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return plain(float(v))
    return v


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in registry.ORACLE_SQL:
        result = oracle.sql(registry.ORACLE_SQL[name])
        at = [result.columns.index(c) for c in columns]
        assert sorted(result.columns) == columns
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
    else:
        assert got
