"""The queries that have SQL against it, and all of them on the smallest tables."""

import duckdb
import pytest

from cardloom.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = Q.queries()[name](spark, SF)
    wanted = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*wanted).fillna(-1).collect())
    result = con.execute(Q.oracle_sql()[name])
    at = [[c[0] for c in result.description].index(w) for w in wanted]
    assert got == sorted(tuple(-1 if r[i] is None else r[i] for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_rows(spark, name):
    small = "/root/testdata/sf0.001"
    got = Q.queries()[name](spark, small)
    table = "pages" if "page_id" in got.columns else "documents"
    key = got.columns[0]
    ids = {r[0] for r in spark.read.parquet(f"{small}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in got.select(key).collect()} == ids
