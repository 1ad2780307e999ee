"""Little-endian binary files of graphs and tables: CSR fragments, edge lists, bitmaps, id maps, matrices, tables of strings.

A file is put together by one task, as its format has it, from parts that any number of tasks have written in order; it is read by
ranges of bytes, by any number of tasks.  Both are streams: no task holds a fragment, whatever its size.
"""

from __future__ import annotations

import itertools
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import EDGE
from ..plans.lineage import delete, shared_folder

FILES = "name string, file binary"
#: Numbers that a task reads or copies at a time.
SOME = 1 << 18
#: Bytes of a file that one task reads, about.
SLICE = 16 << 20


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


def put(path: str, body: bytes | Iterable[bytes]) -> None:
    """Writes one file, given whole or piece by piece, whole or not at all, so that a task may run twice."""
    fs, at = _place(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        for piece in [body] if isinstance(body, bytes) else body:
            out.write(piece)
    fs.move(part, at)


def put_files(files: DataFrame, folder: str) -> int:
    """Writes every row (name, file) to the folder, each by the task that holds it; returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("file").to_pylist(), strict=True):
                put(f"{folder}/{name}", body)
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    return files.select("name", "file").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def get_files(spark: SparkSession, path: str) -> DataFrame:
    """name, file of every binary file in a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("file"))


def parsed(files: DataFrame, of: Callable[[str, bytes], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The rows that a function of (name, bytes) gives for every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("file").to_pylist(), strict=True):
                yield from of(name, body)

    return files.select("name", "file").mapInArrow(run, schema)


def _found(spark: SparkSession, path: str, only: str = "*.bin") -> DataFrame:
    """name, at, length, file of every binary file: `at` can be opened where `file` is null; elsewhere `file` is what it holds."""
    try:
        reached = _place(path) is not None
    except (pa.ArrowException, OSError):  # a file system that only Spark knows
        reached = False
    found = spark.read.format("binaryFile")
    found = (found.option("pathGlobFilter", only) if only else found).load(path)
    at = F.regexp_replace("path", "^file:/+", "/")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), at.alias("at"), "length", (F.lit(None).cast("binary") if reached else F.col("content")).alias("file"))


def _slices(found: DataFrame, length: Column, file: Column) -> DataFrame:
    """A row for each SLICE of a file, with its number `i` and how many there are, `m`, dealt out to all tasks; a file that Spark has to read is one."""
    m = F.when(file.isNull(), F.greatest(F.ceil(length / SLICE), F.lit(1))).otherwise(1).cast("int")
    cut = found.withColumn("m", m).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return cut.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _opened(at: str, file: bytes | None) -> pa.NativeFile:
    if file is not None:
        return pa.BufferReader(file)
    fs, path = _place(at)
    return fs.open_input_file(path)


def numbers(f: pa.NativeFile, kind: str, first: int, n: int) -> np.ndarray:
    """n numbers from a place in bytes on."""
    return np.frombuffer(f.read_at(n * np.dtype(kind).itemsize, first), kind, n)


def steps(n: int, i: int, m: int, size: int = SOME) -> Iterator[tuple[int, int]]:
    """The i-th of m shares of range(n), in steps of `size` at most: first, how many."""
    first, end = n * i // m, n * (i + 1) // m
    for at in range(first, end, size):
        yield at, min(size, end - at)


def sliced(spark: SparkSession, path: str, of: Callable[[str, pa.NativeFile, int, int], Iterator[pa.RecordBatch]], schema: str, only: str = "*.bin") -> DataFrame:
    """The rows that a function of (name, open file, i, m) gives for the i-th of m shares of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, file, i, m in zip(*(batch.column(c).to_pylist() for c in ("name", "at", "file", "i", "m")), strict=True):
                with _opened(at, file) as f:
                    yield from of(name, f, i, m)

    return _slices(_found(spark, path, only), F.col("length"), F.col("file")).select("name", "at", "file", "i", "m").mapInArrow(run, schema)


# ---------------------------------------------------------------- files from parts

#: Of a part: its fragment, its place among the parts, its path without the sections' names, how many vertices, in-edges and out-edges, the largest id.
PARTS = "gid int, first long, path string, v long, n_in long, n_out long, top long"


class _Part:
    """Files of one task for what it has of a fragment, one a section."""

    def __init__(self, folder: str, gid: int, first: int):
        self.gid, self.first, self.path = gid, first, f"{folder}/{uuid.uuid4().hex}"
        self.files: dict[str, pa.NativeFile] = {}
        self.count = {"v": 0, "n_in": 0, "n_out": 0}
        self.top = 0
        self.last: np.ndarray | None = None  # in- and out-degree so far of the last vertex

    def add(self, section: str, x: np.ndarray, kind: str = "<u4") -> None:
        if section not in self.files:
            fs, at = _place(f"{self.path}.{section}")
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            self.files[section] = fs.open_output_stream(at, buffer_size=1 << 18)
        self.files[section].write(np.ascontiguousarray(x.astype(kind)))

    def vertices(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.add("ids", ids)
        self.add("values", values)
        self.count["v"] += len(ids)
        self.top = max(self.top, int(ids.max(initial=0)))

    def degrees(self, x: np.ndarray) -> None:
        """Of each vertex: in- and out-degree; the first row goes to the last vertex so far, and the last may not be whole yet."""
        if self.last is not None:
            x[0] += self.last
        whole = x[:-1] if self.last is not None else x[1:-1] if len(x) > 1 else x[:0]
        if len(whole):
            self.add("din", whole[:, 0], "<u8")
            self.add("dout", whole[:, 1], "<u8")
        self.last = x[-1].copy()

    def row(self) -> pa.RecordBatch:
        if self.last is not None:
            self.degrees(np.zeros((2, 2), np.int64))
        for f in self.files.values():
            f.close()
        row = {"first": self.first, "v": self.count["v"], "n_in": self.count["n_in"], "n_out": self.count["n_out"], "top": self.top}
        return pa.record_batch({"gid": pa.array([self.gid], pa.int32()), "path": pa.array([self.path])} | {k: pa.array([x], pa.int64()) for k, x in row.items()}).select([c.split()[0] for c in PARTS.split(", ")])


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each run of equal numbers begins and ends."""
    at = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return ((a, b) for a, b in itertools.pairwise(at) if b > a)


def _in_parts(folder: str, degrees: bool):
    """Parts of rows (gid, a, kind, b) in that order: a vertex a of value b (kind 0), then its out-edges (1) and its in-edges (2), b the other end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            gid, a, kind, b = (np.asarray(batch.column(i)) for i in range(4))
            for x, y in _runs(gid):
                if part is None or part.gid != gid[x]:
                    if part is not None:
                        yield part.row()
                    part = _Part(folder, int(gid[x]), int(a[x]))
                k, other = kind[x:y], b[x:y]
                own = k == 0
                part.vertices(a[x:y][own], other[own])
                if degrees:
                    at, some = np.cumsum(own), int(own.sum()) + 1
                    sides = []
                    for side, section in ((2, "in"), (1, "out")):
                        on = k == side
                        sides.append(np.bincount(at[on], minlength=some))
                        if on.any():
                            part.add(section, other[on])
                            part.count[f"n_{section}"] += int(on.sum())
                    part.degrees(np.stack(sides, 1))
        if part is not None:
            yield part.row()

    return run


def _pieces(parts: list[dict], section: str, kind: str) -> Iterator[np.ndarray]:
    """A section of a fragment, part by part."""
    for p in parts:
        fs, at = _place(f"{p['path']}.{section}")
        if fs.get_file_info(at).type == pafs.FileType.NotFound:  # a part without any
            continue
        with fs.open_input_file(at) as f:
            for first, n in steps(f.size() // np.dtype(kind).itemsize, 0, 1, SOME):
                yield numbers(f, kind, first * np.dtype(kind).itemsize, n)


def _sums(degrees: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """What stands before each number, added up."""
    done = 0
    for x in degrees:
        till = np.cumsum(x.astype("<u8"))
        yield (till - x + np.uint64(done)).astype("<u8")
        done += int(till[-1])


def _spread(ids: Iterator[np.ndarray], n: int) -> Iterator[np.ndarray]:
    """A u32 for each number below n: its place among the ascending ids, 0 where it is none of them."""
    window, at, place = np.zeros(SOME, "<u4"), 0, 0
    for some in ids:
        some, numbered, place = some.astype(np.int64), np.arange(place, place + len(some)), place + len(some)
        while len(some):
            k = int(np.searchsorted(some, at + SOME))
            window[some[:k] - at] = numbered[:k]
            some, numbered = some[k:], numbered[k:]
            if len(some):
                yield window.copy()
                window[:] = 0
                at += SOME
    for first in range(at, n, SOME):
        yield window[: n - first].copy()
        window[:] = 0


def _zeros(n: int) -> Iterator[bytes]:
    for first in range(0, n, 1 << 20):
        yield bytes(min(1 << 20, n - first))


def _put_together(parts: DataFrame, files: Callable[[int, list[dict]], dict[str, Iterable[bytes]]], folder: str) -> int:
    """Writes the files that a function of (gid, its parts in order) gives for each gid, a gid by one task; returns how many."""

    def run(k: tuple, table: pa.Table) -> pa.Table:
        made = files(k[0].as_py(), sorted(table.to_pylist(), key=lambda p: p["first"]))
        for name, pieces in made.items():
            put(f"{folder}/{name}", (x if isinstance(x, bytes) else memoryview(np.ascontiguousarray(x)).cast("B") for x in pieces))
        return pa.table({"n": pa.array([len(made)], pa.int64())})

    return parts.groupBy("gid").applyInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _sorted_parts(rows: DataFrame, to: str, degrees: bool) -> DataFrame:
    """Parts of rows (gid, a, kind, b)."""
    return rows.select("gid", "a", "kind", "b").repartitionByRange("gid", "a").sortWithinPartitions("gid", "a", "kind", "b").mapInArrow(_in_parts(to, degrees), PARTS)


def _parts_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- CSR fragments: meta, data, vdata

#: Vertices, in-edges, out-edges (u64 each), largest id (u32).
_META = "<QQQI"


def write_fragments(rows: DataFrame, folder: str) -> int:
    """The three files of each fragment of rows (gid, kind, a, b): a vertex a of value b (kind 0), its out-edges to b (1), its in-edges from b (2).

    data: global ids u32, in- and out-degrees u64, in- and out-offsets u64, in- and out-neighbours u32 (global ids, ascending), and
    local ids by global id u32, as many as the largest id rounded up beyond itself to 64.  vdata: values u32, then a u32 for each out-edge.
    """
    to = _parts_folder(rows.sparkSession)

    def files(gid: int, parts: list[dict]) -> dict[str, Iterable[bytes]]:
        v, n_in, n_out = (sum(p[c] for p in parts) for c in ("v", "n_in", "n_out"))
        top = max(p["top"] for p in parts)
        piece = lambda section, kind="<u4": _pieces(parts, section, kind)
        degrees = [lambda: piece("din", "<u8"), lambda: piece("dout", "<u8")]
        data = itertools.chain(piece("ids"), *(d() for d in degrees), *(_sums(d()) for d in degrees), piece("in"), piece("out"), _spread(piece("ids"), (top // 64 + 1) * 64))
        return {f"meta/{gid}.bin": [struct.pack(_META, v, n_in, n_out, top)], f"data/{gid}.bin": data, f"vdata/{gid}.bin": itertools.chain(piece("values"), _zeros(4 * n_out))}

    n = _put_together(_sorted_parts(rows, to, True), files, folder)
    delete(rows.sparkSession, to)
    return n


def write_csr(edges: DataFrame, members: DataFrame, folder: str, values: DataFrame | None = None) -> int:
    """A CSR fragment for each gid.  edges: src, dst; members: id, gid, a row for each fragment that has the vertex; values: id, value.

    A fragment has the out-edges and the in-edges of its members.
    """
    own = members.select("gid", F.col("id").alias("a"))
    own = own.join(values.select(F.col("id").alias("a"), F.col("value").cast("long").alias("b")), "a", "left") if values is not None else own.withColumn("b", F.lit(None).cast("long"))
    rows = own.select("gid", F.lit(0).alias("kind"), "a", F.coalesce("b", F.lit(0)).cast("long").alias("b"))
    out = edges.join(members.select(F.col("id").alias("src"), "gid"), "src").select("gid", F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    into = edges.join(members.select(F.col("id").alias("dst"), "gid"), "dst").select("gid", F.lit(2).alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"))
    return write_fragments(rows.union(out).union(into), folder)


def _csr(spark: SparkSession, folder: str, of: Callable[[int, int, Callable[[str, int, int], np.ndarray], int, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The rows that a function of (gid, V, reader, i, m) gives for the i-th of m shares of every fragment; reader(section, place, n): numbers of a section."""
    one = lambda kind: _found(spark, f"{folder}/{kind}").select(F.regexp_extract("name", r"^(\d+)", 1).cast("int").alias("gid"), F.col("at").alias(kind), F.col("length").alias(f"{kind}_length"), F.col("file").alias(f"{kind}_file"))
    found = one("meta").join(one("data"), "gid").join(one("vdata"), "gid")
    columns = ["gid", *[f"{k}{x}" for k in ("meta", "data", "vdata") for x in ("", "_file")], "i", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _opened(r["meta"], r["meta_file"]) as f:
                    v, n_in, n_out, _ = struct.unpack(_META, f.read_at(struct.calcsize(_META), 0))
                with _opened(r["data"], r["data_file"]) as data, _opened(r["vdata"], r["vdata_file"]) as vdata:
                    begin, places = 0, {"value": (vdata, "<u4", 0)}
                    for name, kind, n in (("ids", "<u4", v), ("in_degree", "<u8", v), ("out_degree", "<u8", v), ("in_offset", "<u8", v), ("out_offset", "<u8", v), ("in_edges", "<u4", n_in), ("out_edges", "<u4", n_out)):
                        places[name] = (data, kind, begin)
                        begin += n * np.dtype(kind).itemsize

                    def read(section: str, at: int, n: int, places: dict = places) -> np.ndarray:
                        f, kind, begin = places[section]
                        return numbers(f, kind, begin + at * np.dtype(kind).itemsize, n).astype(np.int64)

                    yield from of(r["gid"], v, read, r["i"], r["m"])

    return _slices(found, F.col("data_length"), F.col("data_file")).select(*columns).mapInArrow(run, schema)


def read_csr_vertices(spark: SparkSession, folder: str) -> DataFrame:
    """gid, id, local_id, in_degree, out_degree, value."""

    def rows(gid: int, v: int, read: Callable, i: int, m: int) -> Iterator[pa.RecordBatch]:
        for at, n in steps(v, i, m):
            cols = {"id": read("ids", at, n), "local_id": np.arange(at, at + n)} | {c: read(c, at, n) for c in ("in_degree", "out_degree", "value")}
            yield pa.record_batch({"gid": pa.array(np.full(n, gid), pa.int32())} | {k: pa.array(x, pa.int64()) for k, x in cols.items()})

    return _csr(spark, folder, rows, "gid int, id long, local_id long, in_degree long, out_degree long, value long")


def read_csr_edges(spark: SparkSession, folder: str, direction: str = "out") -> DataFrame:
    """gid, src, dst of the out-edges, or the in-edges, of every fragment."""

    def rows(gid: int, v: int, read: Callable, i: int, m: int) -> Iterator[pa.RecordBatch]:
        for at, n in steps(v, i, m):
            ids, till = read("ids", at, n), np.cumsum(read(f"{direction}_degree", at, n))
            begin = int(read(f"{direction}_offset", at, 1)[0])
            for first, k in steps(int(till[-1]), 0, 1):
                own, other = ids[np.searchsorted(till, np.arange(first, first + k), "right")], read(f"{direction}_edges", begin + first, k)
                src, dst = (own, other) if direction == "out" else (other, own)
                yield pa.record_batch({"gid": pa.array(np.full(k, gid), pa.int32()), "src": pa.array(src), "dst": pa.array(dst)})

    return _csr(spark, folder, rows, f"gid int, {EDGE}")


def write_values(values: DataFrame, members: DataFrame, folder: str) -> int:
    """The vdata files alone, anew: values (id, value) in the order of each fragment's ids, without a part for edges."""
    spark = members.sparkSession
    to = _parts_folder(spark)
    rows = members.join(values, "id").select("gid", F.lit(0).alias("kind"), F.col("id").alias("a"), F.col("value").cast("long").alias("b"))
    n = _put_together(_sorted_parts(rows, to, False), lambda gid, parts: {f"vdata/{gid}.bin": _pieces(parts, "values", "<u4")}, folder)
    delete(spark, to)
    return n


# ---------------------------------------------------------------- edge lists: meta, data, vdata

_LIST = "<QQI"


#: Fragments whose edges a task writes at the same time.
_OPEN = 64


def _edge_parts(folder: str):
    """Parts of rows (gid, src, dst) in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Part] = {}
        for batch in batches:
            gid, both = np.asarray(batch.column(0)), np.stack([np.asarray(batch.column(1)), np.asarray(batch.column(2))], 1)
            order = np.argsort(gid, kind="stable")
            gid, both = gid[order], both[order]
            for x, y in _runs(gid):
                g = int(gid[x])
                if g not in held:
                    if len(held) == _OPEN:
                        yield from (p.row() for p in held.values())
                        held.clear()
                    held[g] = _Part(folder, g, -1)
                held[g].add("edges", both[x:y])
                held[g].count["n_out"] += y - x
                held[g].top = max(held[g].top, int(both[x:y].max()))
        yield from (p.row() for p in held.values())

    return run


def write_edge_lists(parts: DataFrame, folder: str, values: DataFrame | None = None) -> int:
    """An edge list for each gid of parts (src, dst, gid): meta (V, E, largest id), data (pairs u32), vdata (a value u32 a vertex, then the vertices' ids u32, ascending)."""
    spark = parts.sparkSession
    to = _parts_folder(spark)
    held = parts.select("gid", F.explode(F.array("src", "dst")).alias("a")).distinct()
    held = held.join(values.select(F.col("id").alias("a"), F.col("value").cast("long").alias("b")), "a", "left") if values is not None else held.withColumn("b", F.lit(None).cast("long"))
    rows = held.select("gid", F.lit(0).alias("kind"), "a", F.coalesce("b", F.lit(0)).cast("long").alias("b"))

    def files(gid: int, parts: list[dict]) -> dict[str, Iterable[bytes]]:
        v, e = (sum(p[c] for p in parts) for c in ("v", "n_out"))
        piece = lambda section: _pieces(parts, section, "<u4")
        return {f"meta/{gid}.bin": [struct.pack(_LIST, v, e, max(p["top"] for p in parts))], f"data/{gid}.bin": piece("edges"), f"vdata/{gid}.bin": itertools.chain(piece("values"), piece("ids"))}

    n = _put_together(parts.select("gid", "src", "dst").mapInArrow(_edge_parts(to), PARTS).union(_sorted_parts(rows, to, False)), files, folder)
    delete(spark, to)
    return n


def read_edge_lists(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst of all edge lists of a folder; a list's length is that of its data."""

    def pairs(_: str, f: pa.NativeFile, i: int, m: int) -> Iterator[pa.RecordBatch]:
        for at, n in steps(f.size() // 8, i, m):
            yield edge_batch(numbers(f, "<u4", 8 * at, 2 * n))

    return sliced(spark, f"{folder}/data", pairs, EDGE)


def edge_batch(both: np.ndarray) -> pa.RecordBatch:
    """src, dst of pairs one after the other."""
    return pa.record_batch({"src": pa.array(both[::2].astype(np.int64)), "dst": pa.array(both[1::2].astype(np.int64))})


def read_edge_list_values(spark: SparkSession, folder: str) -> DataFrame:
    """name, id, value of the vertices of every edge list."""

    def vertices(name: str, f: pa.NativeFile, i: int, m: int) -> Iterator[pa.RecordBatch]:
        v = f.size() // 8
        for at, n in steps(v, i, m):
            value, id = (numbers(f, "<u4", 4 * first, n).astype(np.int64) for first in (at, v + at))
            yield pa.record_batch({"name": pa.array([name] * n, pa.string()), "id": pa.array(id), "value": pa.array(value)})

    return sliced(spark, f"{folder}/vdata", vertices, "name string, id long, value long")


# ---------------------------------------------------------------- bitmaps, maps, matrices


def _put_blocks(rows: DataFrame, width: int, of: Callable[[int, pa.Table], bytes], n: int, head: bytes, path: str) -> None:
    """A file of a head and the bytes for ids 0 to n - 1, made `width` ids at a time by any number of tasks and put together by one; the driver holds a path a block."""
    spark = rows.sparkSession
    to = _parts_folder(spark)

    def block(k: tuple, table: pa.Table) -> pa.Table:
        at = f"{to}/{k[0].as_py()}-{uuid.uuid4().hex}"
        put(at, of(k[0].as_py() * width, table))
        return pa.table({"block": pa.array([k[0].as_py()], pa.int64()), "at": [at]})

    have = {r.block: r.at for r in rows.withColumn("block", F.floor(F.col("id") / width).cast("long")).groupBy("block").applyInArrow(block, "block long, at string").collect()}

    def pieces() -> Iterator[bytes]:
        yield head
        for b in range(-(-n // width)):
            if b in have:
                with _opened(have[b], None) as f:
                    yield f.read()
            else:
                yield of(b * width, pa.table({"id": pa.array([], pa.int64()), "value": pa.array([], pa.int64())}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            put(path, pieces())
            yield batch

    spark.range(1, numPartitions=1).mapInArrow(run, "id long").collect()
    delete(spark, to)


def write_bitmap(ids: DataFrame, path: str) -> None:
    """A set of ids (u32 at most) as bits: how many bits (u64, a multiple of 64 beyond the largest id), how many bytes (u64), the bits.  32 bits an id at most, so 512 MB."""
    top = ids.agg(F.max("id")).first()[0]
    n = 0 if top is None else (top // 64 + 1) * 64
    width = 1 << 23

    def bits(first: int, table: pa.Table) -> bytes:
        mark = np.zeros(min(width, n - first), bool)
        mark[table.column("id").to_numpy() - first] = True
        return np.packbits(mark, bitorder="little").tobytes()

    _put_blocks(ids.select("id"), width, bits, n, struct.pack("<QQ", n, n // 8), path)


def read_bitmap(spark: SparkSession, path: str) -> DataFrame:
    """id of every bit that is set."""

    def bits(_: str, f: pa.NativeFile, i: int, m: int) -> Iterator[pa.RecordBatch]:
        for at, n in steps(struct.unpack("<QQ", f.read_at(16, 0))[1], i, m, SOME // 8):
            yield pa.record_batch({"id": pa.array(np.flatnonzero(np.unpackbits(numbers(f, "u1", 16 + at, n), bitorder="little")) + 8 * at, pa.int64())})

    return sliced(spark, path, bits, "id long")


def write_id_map(ids: DataFrame, path: str) -> None:
    """id, value as an array by id: its length (u64), then a u32 an id (0 where there is none)."""
    top = ids.agg(F.max("id")).first()[0]
    n, width = 0 if top is None else top + 1, 1 << 20

    def numbered(first: int, table: pa.Table) -> bytes:
        out = np.zeros(min(width, n - first), "<u4")
        out[table.column("id").to_numpy() - first] = table.column("value").to_numpy()
        return out.tobytes()

    _put_blocks(ids.select("id", F.col("value").cast("long").alias("value")), width, numbered, n, struct.pack("<Q", n), path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """id, value of every place of the array."""

    def places(_: str, f: pa.NativeFile, i: int, m: int) -> Iterator[pa.RecordBatch]:
        for at, n in steps(struct.unpack("<Q", f.read_at(8, 0))[0], i, m):
            yield pa.record_batch({"id": pa.array(np.arange(at, at + n)), "value": pa.array(numbers(f, "<u4", 8 + 4 * at, n).astype(np.int64))})

    return sliced(spark, path, places, "id long, value long")


def write_matrix(pairs: DataFrame, n: int, path: str) -> None:
    """Pairs of fragments (gid_from, gid_to), n of them, as n (u64) and n * n bytes, a row after the other."""
    mark = np.zeros((n, n), np.uint8)
    for r in pairs.select("gid_from", "gid_to").distinct().collect():  # n * n at most
        mark[r.gid_from, r.gid_to] = 1
    put(path, struct.pack("<Q", n) + mark.tobytes())


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    def cells(_: str, body: bytes) -> Iterator[pa.RecordBatch]:
        n = struct.unpack_from("<Q", body)[0]
        a, b = np.nonzero(np.frombuffer(body, np.uint8, n * n, 8).reshape(n, n))
        yield pa.record_batch({"gid_from": pa.array(a, pa.int32()), "gid_to": pa.array(b, pa.int32())})

    return parsed(get_files(spark, path), cells, "gid_from int, gid_to int")


# ---------------------------------------------------------------- tables of strings


def _cell(n: int) -> int:
    """Bytes of a column's cells: what its longest text takes with a closing 0, rounded up to 8."""
    return (n // 8 + 1) * 8


def write_table(table: DataFrame, folder: str, name: str) -> int:
    """Cells of fixed width, a column's wide enough for its longest text and closed by 0: NAME.json (columns, widths), then data files of rows, a file a partition."""
    import json

    columns = table.columns
    longest = table.agg(*[F.coalesce(F.max(F.octet_length(F.col(f"`{c}`").cast("string"))), F.lit(0)) for c in columns]).first()
    widths = [_cell(n) for n in longest]
    put(f"{folder}/{name}/meta.json", json.dumps({"columns": columns, "widths": widths}).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                cells = [np.array([(x or "").encode() for x in batch.column(i).to_pylist()], f"S{w}").view(np.uint8).reshape(-1, w) for i, w in enumerate(widths)]
                yield pa.record_batch({"name": [f"{name}/{part:06d}-{no:06d}.bin"], "file": pa.array([np.concatenate(cells, axis=1).tobytes()], pa.binary())})
                no += 1

    return put_files(table.select([F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, FILES), folder)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same rows, all strings; null comes back as an empty text, as the format has no other."""
    import json

    spec = json.loads(spark.read.text(f"{folder}/{name}/meta.json", wholetext=True).first()[0])
    columns, widths = spec["columns"], spec["widths"]

    def rows(_: str, body: bytes) -> Iterator[pa.RecordBatch]:
        cells, at = np.frombuffer(body, np.uint8).reshape(-1, sum(widths)), np.cumsum([0, *widths])
        cols = [np.ascontiguousarray(cells[:, a:b]).view(f"S{b - a}")[:, 0] for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.record_batch({f"c{i}": pa.array([x.decode() for x in c.tolist()], pa.string()) for i, c in enumerate(cols)})

    return parsed(get_files(spark, f"{folder}/{name}"), rows, ", ".join(f"c{i} string" for i in range(len(columns)))).toDF(*columns)
