"""Micro-graphs with known answers, invariants and round trips."""

import pytest
from pyspark.sql import functions as F

from graphloom.model import Graph, ends
from graphloom.operators import algorithms as alg
from graphloom.operators import partition as part
from graphloom.operators import transform as tr
from graphloom.operators.contraction import star_components
from graphloom.operators.generate import rmat
from graphloom.plans.superstep import Program, run
from graphloom.sources import graphs, read_graph, read_relations, write_graph, write_relations
from graphloom.streaming.components import StreamingComponents

WORKED = [(0, 2), (0, 3), (1, 0), (3, 1), (3, 4), (4, 1), (4, 2)]


@pytest.fixture(scope="module")
def graph(spark):
    return lambda edges: Graph(spark.createDataFrame(edges, "src long, dst long"))


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_edge_cut_of_worked_example(graph):
    assert pairs(part.edge_cut(graph(WORKED).edges, 2)) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]


def test_components(graph):
    two = [(0, 1), (1, 2), (2, 0), (5, 6), (6, 7), (7, 5)]
    assert pairs(alg.connected_components(graph(two))) == [(0, 0), (1, 0), (2, 0), (5, 5), (6, 5), (7, 5)]
    assert pairs(alg.connected_components(graph([(5, 6), (6, 7), (9, 9)]))) == [(5, 5), (6, 5), (7, 5), (9, 9)]
    assert pairs(alg.connected_components(graph([(0, 64), (63, 64)])))[-1] == (64, 0)
    assert alg.connected_components(graph([])).count() == 0


def test_long_path_takes_few_rounds(graph, spark):
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    for limit in (50, 1_000):  # stars over several tasks; all in one task
        found = star_components(path.repartition(7), max_rounds=12, limit=limit)
        assert found.count() == 301 and found.where("component <> 0").count() == 0


def test_labels_go_along_edges(graph):
    g = graph([(4, 3), (3, 2), (2, 1), (1, 0)])
    assert pairs(alg.min_ancestor_label(g)) == [(i, i) for i in range(5)]
    assert {r.label for r in alg.min_ancestor_label(g.symmetric()).collect()} == {0}


def test_warm_start(graph):
    g = graph([(0, 1), (1, 2), (2, 3)])
    old = graph([(1, 2), (2, 3)])
    start = alg.min_ancestor_label(old).withColumnRenamed("label", "value")
    out = run(g, alg.least_label_program(), 10, start=start)
    assert pairs(out.state) == [(i, 0) for i in range(4)]
    assert out.metrics[0]["active"] == 1


def test_distances(graph):
    assert pairs(alg.sssp(graph([(0, 1), (2, 3)]), 0).na.fill(-1)) == [(0, 0), (1, 1), (2, -1), (3, -1)]
    assert pairs(alg.sssp(graph([(0, 1), (2, 3)]), 0, unreached=True))[-1] == (3, 268_435_455)
    assert pairs(alg.bfs_reachable(graph(WORKED), 4)) == [(0,), (1,), (2,), (3,), (4,)]


def test_ranks(graph):
    g = graph([(1, 2), (3, 2)])
    assert pairs(alg.mean_rank(g, 3)) == [(1, 1.0), (2, 0.01), (3, 1.0)]
    assert pairs(alg.mean_rank_int(g, 3)) == [(1, 1), (2, 0), (3, 1)]
    for edges in ([(0, 1), (1, 0)], [(0, 1), (1, 2)], [(0, 1), (0, 2), (3, 0)]):
        assert abs(sum(r.value for r in alg.pagerank(graph(edges), 20).collect()) - 1) < 1e-9


def test_coloring_has_no_conflict(graph):
    g = graph(WORKED).symmetric()
    colors = alg.coloring(g)
    assert pairs(alg.coloring(g, max_rounds=10)) == pairs(colors)
    with pytest.raises(RuntimeError, match="still clash"):
        alg.coloring(g, max_rounds=1)
    assert alg.coloring_conflicts(g, colors).first()[0] == 0
    assert colors.count() == 5


def test_loops_and_repeats(graph):
    g = graph([(0, 1), (0, 1), (1, 1), (1, 2)])
    assert g.without_loops().edges.count() == 3 and g.deduplicated().edges.count() == 3
    d = {r.id: (r.in_degree, r.out_degree) for r in tr.degrees(g.edges).collect()}
    assert d == {0: (0, 2), 1: (3, 2), 2: (1, 0)}
    assert tr.graph_statistics(g.edges).first().num_edges == 4


def test_repeats_keep_the_least_weight(spark):
    edges = spark.createDataFrame([(0, 1, 5.0), (0, 1, 2.0), (1, 0, 3.0), (1, 2, None)], "src long, dst long, weight double")
    assert pairs(Graph(edges).deduplicated().edges) == [(0, 1, 2.0), (1, 0, 3.0), (1, 2, None)]
    assert [r[2] for r in Graph(edges).symmetric().edges.where("src < 2 and dst < 2").collect()] == [2.0, 2.0]


def test_partitions_cover_all_edges(graph):
    edges = graph([(i * 7 % 40, i * 11 % 40) for i in range(200)] + [(4294967295, 7)]).edges
    for cut in (part.vertex_cut, part.grid_cut, lambda e, n: part.hybrid_cut(e, n, 2)):
        out = cut(edges, 3)
        assert out.count() == 201 and out.where("gid < 0 or gid is null").count() == 0
    stats = part.fragment_statistics(edges, part.edge_cut(edges, 3)).agg(F.sum("num_edges"), F.sum("num_vertexes")).first()
    assert tuple(stats) == (2 * edges.where("src <> dst").count(), ends(edges).count())


def test_simulation_and_walks(graph, spark):
    g = graph([(1, 2), (3, 4), (5, 2)])
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "c")], "id long, label string")
    assert pairs(alg.simulation(g, labels, [("a", "b")])) == [(1, "a"), (2, "b")]
    one, two = alg.random_walks(graph(WORKED), 2, 3, 1), alg.random_walks(graph(WORKED), 2, 3, 1)
    assert pairs(one) == pairs(two)
    assert alg.random_walks(graph([(0, 1)]), 1, 3).count() == 3  # a walk ends where no edge leads on
    assert pairs(alg.random_walks(graph([]), 1, 3)) == []
    steps = {(r.src, r.walk, r.step): r.id for r in one.collect()}
    assert all((a, steps[s, w, i + 1]) in WORKED for (s, w, i), a in steps.items() if (s, w, i + 1) in steps)


def test_own_program(graph):
    sums = run(graph([(0, 2), (1, 2)]), Program(F.col("id") + 1, F.col("value"), "sum", F.col("value") + F.col("msg"), frontier=False), 1)
    assert pairs(sums.state) == [(0, 1), (1, 2), (2, 6)]


def test_formats(graph, spark, tmp_path):
    g = graph(WORKED)
    for form in ("edgelist_csv", "edgelist_bin", "edgelist_bin_folder", "csr_bin", "parquet"):
        write_graph(g, f"{tmp_path}/{form}", form)
        assert pairs(read_graph(spark, f"{tmp_path}/{form}", form).edges) == sorted(WORKED)
    assert pairs(graphs.unpacked(graphs.packed(g.edges).select("file"))) == sorted(WORKED)
    import numpy as np

    (tmp_path / "bin").mkdir()
    a = np.array(WORKED)
    (tmp_path / "bin/0.bin").write_bytes(graphs.pack_edges(a[:, 0], a[:, 1]))
    assert pairs(read_graph(spark, f"{tmp_path}/bin", "edgelist_bin").edges) == sorted(WORKED)
    (tmp_path / "e.csv").write_text("1,2\nx,y\n3,\n\n4,5,6\n")
    assert pairs(read_graph(spark, f"{tmp_path}/e.csv", "edgelist_csv").edges) == [(1, 2), (4, 5)]
    (tmp_path / "w.csv").write_text("1,2,0.5\nx,y,1\n3,4,2\n")
    assert pairs(read_graph(spark, f"{tmp_path}/w.csv", "weight_edgelist_csv").edges) == [(1, 2, 0.5), (3, 4, 2.0)]
    (tmp_path / "h.csv").write_text("a,b\n1,2\n")
    assert pairs(read_graph(spark, f"{tmp_path}/h.csv", "csr_csv").edges) == [(1, 2)]
    assert graphs.read_text(spark, f"{tmp_path}/e.csv", limit=1).count() == 1
    (tmp_path / "e.txt").write_text("1 2\nx\n3 4 9\n")
    assert pairs(read_graph(spark, f"{tmp_path}/e.txt", "edgelist_text", " ").edges) == [(1, 2), (3, 4)]
    write_graph(g, f"{tmp_path}/adj", "adjacency_text")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/adj").collect()]
    assert sorted(lines) == sorted(["AdjacencyGraph", "5", "7", "0", "2", "3", "3", "5", "2", "3", "0", "1", "4", "1", "2"])
    write_relations({"t": g.edges}, f"{tmp_path}/rel")
    assert [k for _, k in spark.read.parquet(f"{tmp_path}/rel/t").dtypes] == ["string", "string"]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert pairs(read_relations(spark, {"t": f"{tmp_path}/t.csv"})["t"]) == [("1", "x")]


def test_rmat(spark):
    g = rmat(spark, 6, 2_000, 0.57, 0.19, 0.19, 0.05, seed=1)
    assert pairs(g) == pairs(rmat(spark, 6, 2_000, 0.57, 0.19, 0.19, 0.05, seed=1))
    assert g.agg(F.max("src")).first()[0] < 64
    with pytest.raises(ValueError):
        rmat(spark, 2, 2, 1, 1, 1, 1)


def test_streaming_components(graph, spark, tmp_path):
    src = f"{tmp_path}/in"
    state = StreamingComponents(spark, f"{tmp_path}/labels")
    for batch in ([(0, 1), (2, 3)], [(1, 2), (8, 9)]):
        graph(batch).edges.write.mode("append").parquet(src)
        state.start(spark.readStream.schema("src long, dst long").parquet(src), f"{tmp_path}/check").awaitTermination()
    assert pairs(state.labels()) == [(0, 0), (1, 0), (2, 0), (3, 0), (8, 8), (9, 8)]


def test_stream_that_starts_anew(graph, spark, tmp_path):
    """Another driver, with the same folder and checkpoint, goes on from the labels; a batch that runs twice changes nothing, and old labels go."""
    import os

    src, want = f"{tmp_path}/in", [(0, 0), (1, 0), (2, 0), (3, 0), (8, 8), (9, 8)]
    for batch in ([(0, 1), (2, 3)], [(1, 2), (8, 9)], [(9, 9)]):
        state = StreamingComponents(spark, f"{tmp_path}/labels")
        graph(batch).edges.write.mode("append").parquet(src)
        state.start(spark.readStream.schema("src long, dst long").parquet(src), f"{tmp_path}/check").awaitTermination()
    assert pairs(state.labels()) == want
    StreamingComponents(spark, f"{tmp_path}/labels").update(graph([(9, 9)]).edges, 2)
    assert pairs(state.labels()) == want
    assert sorted(x for x in os.listdir(f"{tmp_path}/labels") if x.startswith("batch=")) == ["batch=1", "batch=2"]
