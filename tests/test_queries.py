"""Every registered query against its DuckDB SQL at the smallest size."""

import decimal
import os

import duckdb
import pytest

from corvid.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 9)
    return v


def rows(columns, data):
    return sorted(repr([plain(x) for _, x in sorted(zip(columns, r, strict=True), key=lambda p: p[0])]) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, want.fetchall())
