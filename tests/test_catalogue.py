"""Every query of the catalogue against its DuckDB SQL."""

from pathlib import Path

import duckdb
import pytest

from riskloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_like_duckdb(spark, db, name):
    query, sql = catalogue.CATALOGUE[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    want = db.sql(sql)
    assert sorted(want.columns) == columns
    rows = lambda x: sorted(x, key=repr)
    assert rows(tuple(r) for r in df.select(*columns).collect()) == rows(want.select(", ".join(columns)).fetchall())
