"""Queries against their own SQL on a whole table and on awkward rows."""

import os

import duckdb
import pytest

from graphloom.llm import queries as q

from .test_contracts import ROWS


@pytest.fixture(scope="module", params=["table", "awkward"])
def sf(request, spark, tmp_path_factory):
    if request.param == "table":
        return "/root/testdata/sf0.001"
    to = str(tmp_path_factory.mktemp("sql"))
    spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in ROWS], "page_id long, url string").coalesce(1).write.parquet(f"{to}/pages.parquet")
    return to


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df, cur = q.queries()[name](spark, sf), con.execute(q.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(cur.fetchall(), key=str) == sorted((tuple(r) for r in df.select(names).collect()), key=str)
