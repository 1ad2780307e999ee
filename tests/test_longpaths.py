"""Paths longer than any number of steps: fixpoints are whole, and what is not whole is an error."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom import queries as g
from graphloom.model import Graph
from graphloom.operators import algorithms as alg
from graphloom.plans.longpaths import settle
from graphloom.plans.superstep import run


def brute(values, edges, best):
    """Edges are walked until nothing changes."""
    out, moved = dict(values), True
    while moved:
        moved = False
        for a, b, add in edges:
            x = best(out[b], out[a] + add)
            moved, out[b] = moved or x != out[b], x
    return out


def test_unfinished_is_an_error(spark):
    path = Graph(spark.range(6).selectExpr("id as src", "id + 1 as dst"))
    with pytest.raises(RuntimeError, match="no fixpoint after 3 steps"):
        run(path, alg.least_label_program(), 3)
    with pytest.raises(RuntimeError):
        alg.sssp(path, 0, max_iter=3)
    with pytest.raises(RuntimeError):
        alg.simulation(path, path.vertices.withColumn("label", F.lit("a")), [("a", "a")], max_iter=2)


@pytest.mark.parametrize("kind", ["min of a mixed graph", "max of a mixed graph", "longest ascending paths"])
@pytest.mark.parametrize("limit", [1_000_000, 30])  # all in one task; paths contracted first
def test_settle(spark, kind, limit):
    rnd = random.Random(5)
    ids = list(range(400))
    rnd.shuffle(ids)
    edges = list(zip(ids[:150], ids[1:151]))  # a long path, a path both ways, a cycle, a tree, a dense core
    edges += [e for a, b in zip(ids[150:219], ids[151:220]) for e in ((a, b), (b, a))]
    edges += list(zip(ids[220:270], [*ids[221:270], ids[220]]))
    edges += [(ids[270 + (i - 1) // 2], ids[270 + i]) for i in range(1, 60)] + [(rnd.choice(ids[330:350]), rnd.choice(ids[330:350])) for _ in range(90)] + [(ids[10], ids[340]), (ids[7], ids[7])]
    lengths = kind.startswith("longest")
    if lengths:
        edges = [(max(e), min(e)) for e in edges]
    values = {i: 0 if lengths else i for i in ids}
    rows = [(a, b, int(lengths)) for a, b in edges]
    best = min if kind.startswith("min") else max
    out = settle(spark.createDataFrame(list(values.items()), "id long, value long"), spark.createDataFrame(rows, "src long, dst long, add long"), best.__name__, limit)
    assert {r.id: r.value for r in out.collect()} == brute(values, [r for r in rows if r[0] != r[1]], best)
    assert out.count() == len(ids)


def test_queries_on_a_hot_customer(spark, tmp_path, monkeypatch):
    """One customer's path is longer than the steps of the queries."""
    monkeypatch.setattr(alg, "LONG_PATH", 2)
    n = 12_000
    spark.range(n).selectExpr("id as o_orderkey", "cast(0 as bigint) as o_custkey", "timestamp_seconds(id) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    sf = str(tmp_path)
    whole = lambda name, c: g.Q[name](spark, sf).agg(F.count("*"), F.min(c), F.max(c)).first()
    for name in ("components_by_supersteps", "min_ancestor_label"):
        assert tuple(whole(name, "label")) == (n, 0, 0)
    assert g.Q["program_max"](spark, sf).where("id <> value").count() == 0
    assert tuple(g.Q["program_aggregate"](spark, sf).first()) == (1, 0)
    assert g.Q["coloring"](spark, sf).where(F.col("color") != n - 1 - F.col("id")).count() == 0


def test_conflicts_are_sought_on_a_graph_of_many_colours(spark, monkeypatch):
    seen, color = [], alg.coloring
    monkeypatch.setattr(alg, "coloring", lambda graph: seen.append(color(graph)) or seen[-1])
    assert g.Q["coloring_conflicts"](spark, "/root/testdata/sf0.001").first()[0] == 0
    assert seen[0].agg(F.max("color")).first()[0] > 3  # a forest of three levels has three colours


@pytest.mark.parametrize("edge_limit, vertex_limit", [(1_000_000, 1_000_000), (40, 1_000_000), (1_000_000, 20), (40, 15)])
def test_dense_graphs_of_many_colours_take_no_supersteps(spark, monkeypatch, edge_limit, vertex_limit):
    """Where all edges lead to smaller ids, ranges of ids are settled in order, however many colours there are; edges next to the diagonal crowd into few ranges."""
    from graphloom.plans import longpaths, superstep

    monkeypatch.setattr(superstep, "run", lambda *a, **k: pytest.fail("supersteps"))
    monkeypatch.setattr(longpaths, "RANGE_EDGES", edge_limit)
    monkeypatch.setattr(longpaths, "RANGE_VERTICES", vertex_limit)
    rnd = random.Random(3)
    ids = rnd.sample(range(-500, 1_000_000), 120)
    ids.sort()
    edges = {(ids[max(a, b)], ids[min(a, b)]) for a, b in ((rnd.randrange(120), rnd.randrange(120)) for _ in range(900)) if a != b}
    edges |= {(ids[i + j], ids[i]) for i in range(100) for j in (1, 2, 3, 4, 5)}
    values, rows = {i: rnd.randrange(9) for i in [*ids, 2_000_000]}, [(a, b, rnd.randrange(1, 3)) for a, b in edges]
    frames = spark.createDataFrame(list(values.items()), "id long, value long"), spark.createDataFrame(rows, "src long, dst long, add long")
    for best in (max, min):
        out = settle(*frames, best.__name__, limit=30).collect()
        assert {r.id: r.value for r in out} == brute(values, rows, best) and len(out) == len(values)
