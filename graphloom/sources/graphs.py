"""Edge lists as CSV, text, binary and Parquet; adjacency as text and Parquet; workspaces of CSR fragments.

Binary edge lists are pairs of little-endian u32 with a header (V u64, E u64, largest id u32), in one file or, with values of vertices, in
folders meta, data and vdata.  Any number of tasks share a file when it is read; Parquet is the native form.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import EDGE, edge_parts
from ..model import Graph
from ..plans.indexing import dense_index
from ..plans.lineage import cut
from ..operators.transform import adjacency, csr_offsets
from . import binary
from .workspace import Workspace, write_workspace

_HEAD = "<QQI"
#: Edges of one packed file.
FILE_EDGES = 4 << 20


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", header: bool = False, weighted: bool = False) -> DataFrame:
    """Two columns of ids (three with a weight) from a file or a folder; further columns, and lines without two ids, are passed over."""
    kind = EDGE + (", weight double" if weighted else "")
    return spark.read.csv(path, schema=kind, sep=sep, header=header, enforceSchema=True).where("src is not null and dst is not null")


def read_text(spark: SparkSession, path: str, sep: str = ",", limit: int | None = None) -> DataFrame:
    """Edges split from lines of text; lines without two ids are passed over.  `limit` bounds the lines read."""
    lines = spark.read.text(path)
    a, b = edge_parts(F.col("value"), sep)
    return (lines.limit(limit) if limit is not None else lines).select(a.alias("src"), b.alias("dst")).where("src is not null and dst is not null")


def _pairs(f: pa.NativeFile, i: int, m: int) -> Iterator[pa.RecordBatch]:
    """The i-th of m shares of a binary edge list."""
    head = struct.calcsize(_HEAD)
    for at, n in binary.steps(struct.unpack(_HEAD, f.read_at(head, 0))[1], i, m):
        yield binary.edge_batch(binary.numbers(f, "<u4", head + 8 * at, 2 * n))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column(0):
            with pa.BufferReader(file.as_buffer()) as f:  # not copied
                yield from _pairs(f, 0, 1)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return binary.sliced(spark, path, lambda _, f, i, m: _pairs(f, i, m), EDGE, only="")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _body(both: np.ndarray) -> list[bytes | np.ndarray]:
    """One binary edge list of pairs u32, in pieces."""
    ids = np.sort(both, axis=None)
    v = int(np.count_nonzero(ids[1:] != ids[:-1])) + min(1, len(ids))
    return [struct.pack(_HEAD, v, len(both), int(ids[-1]) if len(ids) else 0), both]


def pack_edges(src: np.ndarray, dst: np.ndarray) -> bytes:
    """One binary edge list."""
    return b"".join(_body(np.ascontiguousarray(np.stack([src, dst], 1).astype("<u4"))))


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes | np.ndarray]]]:
    """Name and pieces of binary edge lists of FILE_EDGES at most; each has to be used up before the next."""
    from pyspark import TaskContext

    part, no, n, both = TaskContext.get().partitionId(), 0, 0, np.empty((1 << 16, 2), "<u4")
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, FILE_EDGES - n)
            at += some.num_rows
            if n + some.num_rows > len(both):
                more = np.empty((min(FILE_EDGES, max(2 * len(both), n + some.num_rows)), 2), "<u4")
                more[:n] = both[:n]
                both = more
            both[n : n + some.num_rows, 0], both[n : n + some.num_rows, 1] = np.asarray(some.column(0)), np.asarray(some.column(1))
            n += some.num_rows
            if n == FILE_EDGES:
                yield f"{part:06d}-{no:06d}.bin", _body(both)
                no, n = no + 1, 0
    if n:
        yield f"{part:06d}-{no:06d}.bin", _body(both[:n])


def packed(edges: DataFrame) -> DataFrame:
    """name, file: the edges as binary edge lists of FILE_EDGES at most, which no task holds more of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, pieces in _packs(batches):
            yield pa.record_batch({"name": [name], "file": pa.array([b"".join(pieces)], pa.binary())})

    return edges.select("src", "dst").mapInArrow(run, binary.FILES)


def write_binary(edges: DataFrame, folder: str) -> int:
    """Files that read_binary() reads, each written by the task that packs it; returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for name, pieces in _packs(batches):
            binary.put(f"{folder}/{name}", pieces)
            n += 1
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    return edges.select("src", "dst").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def unpacked(files: DataFrame) -> DataFrame:
    return files.select("file").mapInArrow(_unpacked, EDGE)


def adjacency_text(edges: DataFrame) -> DataFrame:
    """section, place, value: the lines of an AdjacencyGraph file: header, V, E, then V offsets and E targets."""
    rows = cut(csr_offsets(edges).select("id", "out_degree", "out_offset"))
    offsets = rows.select(F.lit(1).alias("section"), F.col("id").alias("place"), F.col("out_offset").cast("string").alias("value"))
    told_apart = edges.select("src", "dst").withColumn("_at", F.monotonically_increasing_id())
    targets = dense_index(told_apart, ["src", "dst", "_at"], "place").select(F.lit(2).alias("section"), "place", F.col("dst").cast("string").alias("value"))  # an edge's place in order is its place in the file
    sizes = rows.agg(F.count("*").alias("v"), F.sum("out_degree").alias("e"))
    head = sizes.select(F.posexplode(F.array(F.lit("AdjacencyGraph"), F.col("v").cast("string"), F.col("e").cast("string"))).alias("i", "value")).select(F.lit(0).alias("section"), F.col("i").cast("long").alias("place"), "value")
    return head.unionByName(offsets).unionByName(targets)


def write_adjacency_text(edges: DataFrame, path: str) -> None:
    """A folder of text parts that are one file end to end."""
    adjacency_text(edges).repartitionByRange("section", "place").sortWithinPartitions("section", "place").select("value").write.mode("overwrite").text(path)


def write_csv(edges: DataFrame, path: str, sep: str = ",", files: int | None = None) -> None:
    (edges.coalesce(files) if files else edges).write.mode("overwrite").csv(path, sep=sep)


#: Formats that are read as graphs; tables of strings have readers of their own in relations.
FORMATS = ("edgelist_csv", "weight_edgelist_csv", "edgelist_text", "edgelist_bin", "edgelist_bin_folder", "csr_bin", "csr_csv", "parquet")


def read_graph(spark: SparkSession, path: str, format: str = "parquet", sep: str = ",") -> Graph:
    readers = {
        "edgelist_csv": lambda: read_csv(spark, path, sep), "weight_edgelist_csv": lambda: read_csv(spark, path, sep, weighted=True), "edgelist_text": lambda: read_text(spark, path, sep),
        "edgelist_bin": lambda: read_binary(spark, path), "edgelist_bin_folder": lambda: binary.read_edge_lists(spark, path), "csr_bin": lambda: Workspace(spark, path).edges().select("src", "dst"),
        "csr_csv": lambda: read_csv(spark, path, ",", header=True), "parquet": lambda: read_parquet(spark, path),
    }
    if format not in readers:
        raise ValueError(f"format {format!r} is none of {FORMATS}")
    return Graph(readers[format]())


def write_graph(graph: Graph, path: str, format: str = "parquet", sep: str = ",") -> None:
    if format == "edgelist_csv":
        write_csv(graph.edges, path, sep)
    elif format == "adjacency_text":
        write_adjacency_text(graph.edges, path)
    elif format == "edgelist_bin":
        write_binary(graph.edges, path)
    elif format == "edgelist_bin_folder":
        binary.write_edge_lists(graph.edges.withColumn("gid", F.lit(0)), path)
    elif format == "csr_bin":
        write_workspace(graph.edges, path)
    elif format == "csr":
        adjacency(graph.edges).write.mode("overwrite").parquet(path)
    elif format == "parquet":
        graph.edges.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"format {format!r} can't be written")
