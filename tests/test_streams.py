"""Binary files are written and read as streams: memory doesn't grow with a fragment, and tasks share a file."""

import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.sources import binary, graphs, write_workspace


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def peak_mb(f):
    tracemalloc.start()
    f()
    mb = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return mb


def fragment_rows(batches, size=10_000):
    """Batches of one fragment: every vertex with one out-edge and one in-edge."""
    for i in range(batches):
        at = np.arange(i * size, (i + 1) * size)
        yield pa.record_batch({"gid": pa.array(np.zeros(size, np.int32)), "a": pa.array(at // 3), "kind": pa.array((at % 3).astype(np.int32)), "b": pa.array(at)})


def test_parts_and_files_of_any_length_take_bounded_memory(tmp_path):
    seen = []
    for n in (3, 900):  # the first loads modules
        rows = []
        made = peak_mb(lambda n=n, rows=rows: rows.extend(r for b in binary._in_parts(f"{tmp_path}/{n}", True)(fragment_rows(n)) for r in b.to_pylist()))
        ids, top = lambda rows=rows: binary._pieces(rows, "ids", "<u4"), rows[-1]["top"]
        held = peak_mb(lambda ids=ids, top=top, n=n, rows=rows: binary.put(f"{tmp_path}/{n}.bin", (x.tobytes() for section in (ids(), binary._sums(binary._pieces(rows, "din", "<u8")), binary._spread(ids(), top + 1)) for x in section)))
        assert [(r["v"], r["n_in"], r["n_out"]) for r in rows] == [(n * 10_000 // 3, n * 10_000 // 3, n * 10_000 // 3)]
        seen.append((made, held))
    assert seen[1][0] < 4 and seen[1][1] < 20  # the files of 3,000,000 vertices take 72 MB


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    binary.write_id_map(spark.createDataFrame([(9_000_000, 7), (5, 3)], "id long, value long"), f"{tmp_path}/map.bin")
    found = binary.read_id_map(spark, f"{tmp_path}/map.bin")
    assert tasks(found) > 1 and found.count() == 9_000_001 and pairs(found.where("value > 0")) == [(5, 3), (9_000_000, 7)]
    both = np.arange(6_000_000, dtype="<u4")
    (tmp_path / "l/data").mkdir(parents=True)
    (tmp_path / "l/data/0.bin").write_bytes(both.tobytes())
    assert tasks(binary.read_edge_lists(spark, f"{tmp_path}/l")) > 1 and binary.read_edge_lists(spark, f"{tmp_path}/l").count() == 3_000_000


@pytest.mark.parametrize("strategy", ["edgecut", "vertexcut"])
def test_hubs_and_gaps(spark, tmp_path, strategy):
    """A vertex whose edges fill several batches, repeated edges, loops, ids far apart."""
    edges = [(7, i) for i in range(25_000)] + [(i % 50, 7) for i in range(25_000)] + [(3, 1_500_000), (1_500_000, 3), (9, 9)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    w = write_workspace(frame, f"{tmp_path}/w", strategy, 3, spark.createDataFrame([(7, 5), (1_500_000, 6)], "id long, value long"))
    assert pairs(w.edges().select("src", "dst")) == sorted(edges) and pairs(w.edges("in").select("src", "dst")) == sorted(edges)
    out, into = {}, {}
    for a, b in edges:
        out[a], into[b] = out.get(a, 0) + 1, into.get(b, 0) + 1
    v = w.vertices()
    assert {r.id: (r[1], r[2]) for r in v.groupBy("id").agg(F.sum("out_degree"), F.sum("in_degree")).collect()} == {i: (out.get(i, 0), into.get(i, 0)) for i in out.keys() | into.keys()}
    assert {(r.id, r.value) for r in v.where("value > 0").collect()} == {(7, 5), (1_500_000, 6)}
    w.write_values(v.select("id").distinct().select("id", (F.col("id") % 11).alias("value")))
    assert w.vertices().where("value <> id % 11").count() == 0 and w.vertices().count() == v.count()


def test_edge_lists_of_many_fragments(spark, tmp_path):
    """More fragments than a task has open at a time."""
    parts = spark.range(60_000, numPartitions=2).select(F.col("id").alias("src"), (F.col("id") * 7 % 1_000).alias("dst"), F.pmod("id", F.lit(150)).cast("int").alias("gid"))
    assert binary.write_edge_lists(parts, str(tmp_path), spark.range(1_000).select("id", (F.col("id") + 1).alias("value"))) == 450
    assert pairs(binary.read_edge_lists(spark, str(tmp_path))) == pairs(parts.select("src", "dst"))
    seen = binary.read_edge_list_values(spark, str(tmp_path))
    assert seen.where("value <> if(id < 1000, id + 1, 0)").count() == 0
    assert seen.count() == parts.select("gid", F.explode(F.array("src", "dst"))).distinct().count()


def test_a_binary_list_is_read_by_several_tasks(spark, tmp_path):
    both = np.arange(6_000_000, dtype="<u4")
    (tmp_path / "e").mkdir()
    (tmp_path / "e/0.bin").write_bytes(struct.pack("<QQI", len(both), len(both) // 2, int(both[-1])) + both.tobytes())
    edges = graphs.read_binary(spark, f"{tmp_path}/e")
    assert edges.select(F.spark_partition_id()).distinct().count() > 1 and edges.where("dst = src + 1").agg(F.count("*"), F.sum("src")).first()[:] == (3_000_000, sum(range(0, 6_000_000, 2)))


def test_packed_lists_hold_one_file_at_most(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graphs, "FILE_EDGES", 1_000_000)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    batches = lambda: (pa.record_batch({"src": pa.array(np.arange(i, i + 10_000)), "dst": pa.array(np.arange(10_000))}) for i in range(0, 2_500_000, 10_000))
    found = []
    assert peak_mb(lambda: found.extend((name, pieces[0], len(pieces[1])) for name, pieces in graphs._packs(batches()))) < 30  # files of 8 MB
    assert [n for _, _, n in found] == [1_000_000, 1_000_000, 500_000] and found[0][1] == struct.pack("<QQI", 1_000_000, 1_000_000, 999_999)
    monkeypatch.undo()
    edges = spark.range(50_000).select(F.col("id").alias("src"), (F.col("id") % 100).alias("dst"))
    graphs.write_binary(edges, f"{tmp_path}/e")
    assert pairs(graphs.read_binary(spark, f"{tmp_path}/e")) == pairs(edges) == pairs(graphs.unpacked(graphs.packed(edges).select("file")))


def test_fragments_are_mapped_in_pieces(spark, monkeypatch):
    """A kernel never sees more than a piece of a fragment, all rows of a source in it, and the merged rows are those of whole fragments."""
    from graphloom.plans import superstep

    monkeypatch.setattr(superstep, "PIECE_ROWS", 2_000)
    parts = spark.range(40_000).select((F.col("id") % 997).alias("src"), F.col("id").alias("dst"), (F.col("id") % 997 % 2).cast("int").alias("gid"))
    largest = lambda gid, t: pa.table({"gid": pa.array([gid], pa.int32()), "rows": [t.num_rows], "sources": [len(t.column("src").unique())]})
    added = lambda gid, t: pa.table({"gid": pa.array([gid], pa.int32()), "rows": [max(t.column("rows").to_pylist())], "sources": [sum(t.column("sources").to_pylist())]})
    found = {r.gid: r for r in superstep.active_map(parts, largest, "gid int, rows long, sources long", added).collect()}
    assert {g: r.sources for g, r in found.items()} == {0: 499, 1: 498} and all(r.rows < 6_000 for r in found.values())
