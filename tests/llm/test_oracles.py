"""The operators with SQL against DuckDB, over the shipped tables."""

from pathlib import Path

import duckdb
import pytest

from riskloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_duckdb(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name]).select(", ".join(columns)).fetchall()
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted(want, key=repr)
