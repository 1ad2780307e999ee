"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from graphloom import queries as g

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.parametrize("name", sorted(set(g.SQL) - {"program_max", "program_aggregate", "components_by_supersteps", "csr_in_edges", "csr_round_trip_vertexcut", "workspace_fragments", "workspace_id_map", "workspace_matrix", "workspace_values"}))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = g.Q[name](spark, SF)
    cur = con.execute(g.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert key(cur.fetchall()) == key(tuple(r) for r in df.select(names).collect())


def test_other_queries(spark):
    for name in set(g.Q) - set(g.SQL):
        assert g.Q[name](spark, SF).count() > 0
