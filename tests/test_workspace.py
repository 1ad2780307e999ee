"""Workspaces and binary files byte by byte, the command line, and partitions of many tasks."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.operators import partition as part
from graphloom.sources import binary, read_folder, relations, write_workspace

WORKED = [(0, 2), (0, 3), (1, 0), (3, 1), (3, 4), (4, 1), (4, 2)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(WORKED, "src long, dst long")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_layout_of_a_fragment(edges, spark, tmp_path):
    """The worked example in two fragments: {0, 1, 2} and {3, 4}."""
    w = write_workspace(edges, f"{tmp_path}/w", "edgecut", 2, spark.createDataFrame([(i, 10 + i) for i in range(5)], "id long, value long"))
    assert (tmp_path / "w/meta/1.bin").read_bytes() == struct.pack("<QQQI", 2, 2, 4, 4)
    data = np.frombuffer((tmp_path / "w/data/1.bin").read_bytes(), "<u4")
    u64 = lambda *x: [y for v in x for y in (v, 0)]
    assert data.tolist()[:2] == [3, 4]
    assert data.tolist()[2:18] == u64(1, 1, 2, 2, 0, 1, 0, 2)  # in-degrees, out-degrees, in-offsets, out-offsets
    assert data.tolist()[18:24] == [0, 3, 1, 4, 1, 2] and data.tolist()[24:] == [0, 0, 0, 0, 1] + [0] * 59
    assert np.frombuffer((tmp_path / "w/vdata/1.bin").read_bytes(), "<u4").tolist() == [13, 14, 0, 0, 0, 0]
    assert (tmp_path / "w/border/communication_matrix.bin").read_bytes() == struct.pack("<Q", 2) + bytes([0, 1, 1, 0])
    assert pairs(w.border()) == [(0,), (1,), (2,), (3,), (4,)]
    assert pairs(w.id_map()) == [(0, 0), (1, 1), (2, 2), (3, 0), (4, 1)]
    (tmp_path / "w/data/0.bin").unlink()
    with pytest.raises(Exception, match="lacks a file"):
        w.fragments().collect()


@pytest.mark.parametrize("strategy", sorted(part.STRATEGIES))
def test_every_strategy_keeps_all_edges(edges, spark, tmp_path, strategy):
    w = write_workspace(edges, f"{tmp_path}/w", strategy, 3)
    assert pairs(w.edges().select("src", "dst")) == WORKED and pairs(w.edges("in").select("src", "dst")) == WORKED
    assert w.statistics().agg(F.sum("num_vertexes")).first()[0] == 5
    assert w.vertices().select("id").distinct().count() == 5


def test_bitmap_of_a_top_id_that_is_a_multiple_of_64(spark, tmp_path):
    for ids in ([0, 64], [63], [128, 5, 8_400_000], []):
        binary.write_bitmap(spark.createDataFrame([(i,) for i in ids], "id long"), f"{tmp_path}/{len(ids)}.bin")
        assert pairs(binary.read_bitmap(spark, f"{tmp_path}/{len(ids)}.bin")) == sorted((i,) for i in ids)


def test_tables_of_strings(spark, tmp_path):
    table = spark.createDataFrame([("a", "", "é" * 9), (None, "x,y", "1")], "a string, b string, `c.d` string")
    relations.write_binary({"t": table}, str(tmp_path))
    assert pairs(relations.read_binary(spark, str(tmp_path), ["t"])["t"]) == [("", "x,y", "1"), ("a", "", "é" * 9)]
    relations.write_folder({"one": table, "two": table.limit(1)}, f"{tmp_path}/csv")
    (tmp_path / "csv/three.csv").write_text("k,v\n1,2\n")
    found = read_folder(spark, f"{tmp_path}/csv")
    assert sorted(found) == ["one", "three", "two"] and found["one"].count() == 2 and found["three"].columns == ["k", "v"]


def test_edge_lists_with_values(edges, spark, tmp_path):
    binary.write_edge_lists(part.vertex_cut(edges, 2), str(tmp_path), spark.createDataFrame([(3, 7)], "id long, value long"))
    assert pairs(binary.read_edge_lists(spark, str(tmp_path))) == WORKED
    seen = binary.read_edge_list_values(spark, str(tmp_path))
    assert {r.value for r in seen.where("id = 3").collect()} == {7} and {r.value for r in seen.where("id <> 3").collect()} == {0}


def test_split_of_the_largest_fragment(edges):
    assert pairs(part.edge_cut_split(edges, 2, 1)) == pairs(part.edge_cut(edges, 2))
    gids = dict(pairs(part.edge_cut_split(edges, 2, 2)))
    assert gids == {3: 0, 4: 0, 0: 1, 1: 2, 2: 1}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "e.csv").write_text("\n".join(f"{a},{b}" for a, b in WORKED))
    src = f"{tmp_path}/e.csv"
    cli.main(["wcc", "-i", src, "-o", f"{tmp_path}/wcc"])
    assert {r.label for r in spark.read.parquet(f"{tmp_path}/wcc").collect()} == {0}
    with pytest.raises(RuntimeError):
        cli.main(["coloring", "-i", src, "--niters", "1"])
    cli.main(["partition", "-i", src, "-n", "2", "--workspace", "-o", f"{tmp_path}/w"])
    cli.main(["pr", "-i", f"{tmp_path}/w", "--format", "csr_bin", "--niters", "3", "-o", f"{tmp_path}/pr"])
    assert abs(spark.read.parquet(f"{tmp_path}/pr").agg(F.sum("value")).first()[0] - 1) < 1e-9
    cli.main(["compact", "-i", src, "--to", "edgelist_bin", "-o", f"{tmp_path}/c"])
    cli.main(["show", "-i", f"{tmp_path}/c", "--format", "edgelist_bin", "--count", "3"])
    cli.main(["generate", "--power", "5", "--edges", "200", "-o", f"{tmp_path}/g"])
    assert spark.read.csv(f"{tmp_path}/g").count() > 50
    cli.main(["replace-sep", "-i", src, "--sep", ",", "--new", ";", "-o", f"{tmp_path}/s"])
    cli.main(["convert", "-i", f"{tmp_path}/s", "--sep", ";", "--to", "adjacency_text", "-o", f"{tmp_path}/a"])
    assert "AdjacencyGraph" in {r.value for r in spark.read.text(f"{tmp_path}/a").collect()}
    cli.main(["partition", "-i", src, "-n", "2", "--partitioner", "vertexcut", "-o", f"{tmp_path}/p"])
    assert spark.read.parquet(f"{tmp_path}/p").count() == 7
    assert "+---+" in capsys.readouterr().out
