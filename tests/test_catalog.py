"""Every registered plan against its SQL in DuckDB, and its result under another partitioning."""

import math
import os

import duckdb
import pytest

from cardloom import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FLOATING = {"token_mix"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, int, str)):
        return v
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return round(float(v), 6)
    return str(v)


def rows_of(names, rows, wanted):
    at = [names.index(w) for w in wanted]
    return sorted(([plain(r[i]) for i in at] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_plan(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    wanted = sorted(df.columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()], wanted)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == wanted
    assert got == rows_of(names, result.fetchall(), wanted)


@pytest.mark.parametrize("name", ["ingest", "dense_ids", "knn_percpos", "near_dup_greedy", "grouped_bins", "ratchet_fold", "ema_tripwire", "lane_cursor", "manifest", "dedup_last_wins"])
@pytest.mark.parametrize("parts", ["1", "16"])
def test_partitions_dont_matter(spark, name, parts):
    run = lambda: sorted(map(str, catalog.queries()[name](spark, SF).collect()))
    want, before = run(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert run() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() and set(catalog.queries()) <= set(e.queries()) and set(catalog.oracle_sql()) <= set(e.oracle_sql())
    assert os.path.isdir(e.HERE)


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.queries()["retention"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,signup)]" in plan and "props" not in plan.split("ReadSchema")[1]
    for name in catalog.queries():
        if name not in ("quartile_gate", "segment_rollup"):
            assert "CartesianProduct" not in catalog.queries()[name](spark, SF)._jdf.queryExecution().toString()
