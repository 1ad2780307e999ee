"""op8 against its SQL and on awkward rows: listed, unlisted and false-positive URLs, a broadcast filter and a joined one."""

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries as q
from graphloom.llm import url_filter

URLS = [f"http{'s' * (i % 2)}://{'www.' * (i % 3 == 0)}host{i % 37}.example.{['org', 'com', 'net'][i % 3]}/p{i % 91}{'/' * (i % 2)}{'?q=1' * (i % 5 == 0)}" for i in range(600)]
URLS += ["http://example.net/en/x", "http://a.example.net/", "http://example.com/de/x", "http://x.org/fr/y", "HTTP://UPPER.example.ORG/A#top", "no url", "", "://", "x://", "a://b://c", "http://é.example.org/中"]
URLS += [None] * 300 + ["no url"] * 200 + ["http://hot.example.org/page"] * 400  # keys that hold a third of all rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("pages"))
    rows = [(i, u, None, i % 2 == 0, None) for i, u in enumerate(URLS)] + [(3, URLS[3], None, True, None), (None, URLS[4], None, True, None)]
    spark.createDataFrame(rows, "page_id long, url string, host string, possible boolean, key string").write.parquet(f"{to}/pages.parquet")
    return to


def wanted(sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet/*.parquet')")
    return sorted(con.execute(q.oracle_sql()["op8_url_filter"]).fetchall(), key=str)


@pytest.mark.parametrize("joined", [False, True])
@pytest.mark.parametrize("false_positives", [False, True])
def test_query(spark, sf, monkeypatch, joined, false_positives):
    if false_positives:  # every URL has the bits of every listed one; the exact join alone decides
        monkeypatch.setattr(url_filter, "_bits", lambda key: [F.lit(0)] * 8)
    if joined:  # the filter is too large to be broadcast
        monkeypatch.setattr(url_filter, "MOST_BLOCKS", 0)
    rows = sorted((tuple(r) for r in q.op8_url_filter(spark, sf).collect()), key=str)
    assert rows == wanted(sf)
    by_list = [r for r in rows if r[3] is None and r[4] == "block"]
    assert by_list and all(r[1] for r in by_list) and any(r[3] is None and r[4] == "allow" for r in rows)


def test_every_listed_url_passes_the_filter_and_some_others_do(spark):
    listed = spark.range(3_000).select(F.concat(F.lit("host/p"), "id").alias("canonical"))
    n = 3_000 * url_filter.BITS // 512
    seen = url_filter._passes(spark.range(200_000).select(F.concat(F.lit("host/p"), "id").alias("key"), "id"), url_filter.bloom(listed, n), n)
    hits, others = seen.where("id < 3000 and possible").count(), seen.where("id >= 3000 and possible").count()
    assert hits == 3_000 and 0 < others < 0.02 * 197_000


@pytest.mark.parametrize("listed", [[], [None], ["", "", None], ["host1.example.com/p1"]])
def test_small_lists(spark, sf, listed):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = url_filter.judge(pages, spark.createDataFrame([(x,) for x in listed], "canonical string"), [])
    assert out.count() == pages.count()
    blocked = out.where("verdict = 'block'")
    assert blocked.where("host <> '' or path <> ''").count() == blocked.count() if "" not in listed else blocked.where("host = '' and path = ''").count() >= 500


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, q.op8_listed(pages), q.RULES).count() == 0


def test_list_occurs_at_every_scale(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        out = q.op8_url_filter(spark, sf_dir)
        assert out.where("rule is null and verdict = 'block'").count() > 0 and out.where("rule is null and verdict = 'allow'").count() > 0
