"""Files of token ids: canonical length-limited Huffman codes from global counts.

Layout of one file, little-endian: magic `GLHF`, version, texts n, ids m, blocks b (u32 each); first
id's place in its range of texts (u64); n doc ids (i64); n id counts (u32); b bit offsets (u64); the
bit stream.  The code table, one byte of length for each id, is the row of part -1 beside them, so the files can be
read by themselves.  A store that only Spark writes takes the files as values of a binary column.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text, huffman
from ._store import Store
from ._tokens import encoder

#: Ids that end a file, so that a task holds little at a time.
FILE_IDS = 1 << 20
#: Ids that one task sorts and writes.
TASK_IDS = 8 << 20
_HEAD = "<4sIIIIQ"


def encoding(path: str, end: int | None):
    """A function of batches (doc_id, text) that gives batches (doc_id, n, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = id_type(enc.library.get_vocab_size())
        for batch in batches:
            for part in _text.blocks(batch, "text"):
                ids, ptr = enc.encode(part.column(1))
                if end is not None:
                    ids, ptr = np.insert(ids, ptr[1:], np.uint32(end)), ptr + np.arange(len(ptr))
                size = kind.itemsize
                raw = pa.py_buffer(ids.astype(kind).tobytes())
                col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ptr) - 1, [None, pa.py_buffer((ptr * size).astype(np.int64).tobytes()), raw]).cast(pa.binary())
                yield pa.record_batch({"doc_id": part.column(0), "n": pa.array(np.diff(ptr), pa.int64()), "ids": col})

    return run


def encoded(docs: DataFrame, path: str, end: int | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, ids (unsigned 16-bit, or 32-bit for a larger vocabulary, little-endian) of every whole text, `end` appended; null text is empty."""
    _text.small_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encoding(path, end), "doc_id long, n long, ids binary")


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def _histogram(kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = _text.buffers(batch.column(0))
            n = np.bincount(np.frombuffer(data.tobytes(), kind), minlength=len(total))
            n[: len(total)] += total
            total = n
        at = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return run


def write(docs: DataFrame, path: str, end: int | None, id: str = "doc_id", text: str = "text", store: Store | None = None) -> DataFrame:
    """Encodes all texts and writes them in ascending order of id: a written table (part, no, n, file), the code table in part -1.

    Texts are encoded once, into a table of the shared store.  Null ids come first; rows of one id stand together, in the order
    in which they were encoded, so that any number of them is dealt over several tasks.  An empty table gives the code table alone.
    """
    from tokenizers import Tokenizer

    _text.one_thread()
    spark, kind, store = docs.sparkSession, id_type(Tokenizer.from_file(path).get_vocab_size()), store or Store(docs.sparkSession)
    table = store.written(encoded(docs, path, end, id, text).withColumn("at", F.monotonically_increasing_id()), "ids")
    counts = table.select("ids").mapInArrow(_histogram(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for an id of the vocabulary
    n = np.zeros(max([1, *(r.id + 1 for r in counts)]), np.int64)
    for r in counts:
        n[r.id] = r.n
    length = huffman.lengths(n)
    shipped = spark.sparkContext.broadcast((huffman.codes(length), length))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, size = shipped.value
        docs_, counts_, held, ids_, done, no = [], [], 0, [], 0, 0

        def file() -> pa.RecordBatch:
            nonlocal docs_, counts_, held, ids_, done, no
            ids = np.concatenate(ids_)
            stream, starts = huffman.encode(ids, code, size)
            doc, count = np.concatenate(docs_), np.concatenate(counts_)
            body = struct.pack(_HEAD, b"GLHF", 1, len(doc), len(ids), len(starts), done) + doc.astype("<i8").tobytes() + count.astype("<u4").tobytes() + starts.astype("<u8").tobytes() + stream
            out = pa.record_batch({"no": pa.array([no], pa.int32()), "n": pa.array([len(ids)], pa.int64()), "file": pa.array([body], pa.binary())})
            docs_, counts_, held, ids_, done, no = [], [], 0, [], done + len(ids), no + 1
            return out

        for batch in batches:
            data, off = _text.buffers(batch.column(2))
            flat = np.frombuffer(data.tobytes(), kind)
            doc, ptr = np.asarray(pc.fill_null(batch.column(0), NO_ID)), off // kind.itemsize
            at = 0
            while at < len(doc):
                to = min(len(doc), max(at + 1, int(np.searchsorted(ptr, ptr[at] + FILE_IDS - held, "right")) - 1))
                docs_.append(doc[at:to]), counts_.append(np.diff(ptr[at : to + 1])), ids_.append(flat[ptr[at] : ptr[to]])
                held, at = held + int(ptr[to] - ptr[at]), to
                if held >= FILE_IDS // 2:
                    yield file()
        if docs_:
            yield file()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n.sum()) // TASK_IDS)
    order = [F.col("doc_id").asc_nulls_first(), F.col("at").asc()]
    ordered = table.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    made = ordered.mapInArrow(files, "no int, n long, file binary").select(F.spark_partition_id().alias("part"), "no", "n", "file")
    code = spark.createDataFrame([(CODE_TABLE, 0, 0, bytearray(length.tobytes()))], made.schema)
    out = store.written(made.union(code), "token-files", compression="uncompressed")
    store.drop(table)
    return out


#: Stands in a file for a null id; the part of the code table.
NO_ID, CODE_TABLE = -(1 << 63), -1


def read(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all texts before it), n, ids (unsigned 32-bit, little-endian) from the files alone."""
    spark: SparkSession = files.sparkSession
    code = files.where(F.col("part") == CODE_TABLE).select("file").first()
    if code is None:
        raise ValueError("the files lack their code table")
    files = files.where(F.col("part") != CODE_TABLE)
    per = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one sum a partition
    base, done = {}, 0
    for part in sorted(per):
        base[part], done = done, done + per[part]
    shipped = spark.sparkContext.broadcast(np.frombuffer(code.file, np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = huffman.tables(shipped.value)
        for batch in batches:
            for part, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc, count, ids, first = parse(body.as_py(), table)
                ptr = np.concatenate([[0], np.cumsum(count.astype(np.int64))])
                ids = ids.astype("<u4")
                yield pa.record_batch({"doc_id": pa.array(doc, pa.int64(), mask=doc == NO_ID), "start": pa.array(base[part] + first + ptr[:-1], pa.int64()), "n": pa.array(np.diff(ptr), pa.int64()), "ids": pa.array([ids[a:b].tobytes() for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)], pa.binary())})

    return files.select("part", "file").mapInArrow(run, "doc_id long, start long, n long, ids binary")


def parse(body: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Doc ids, id counts, ids and the first id's place of one file."""
    magic, version, n, m, b, first = struct.unpack_from(_HEAD, body)
    if (magic, version) != (b"GLHF", 1):
        raise ValueError("not a token file")
    at = struct.calcsize(_HEAD)
    doc = np.frombuffer(body, "<i8", n, at)
    count = np.frombuffer(body, "<u4", n, at + 8 * n)
    starts = np.frombuffer(body, "<u8", b, at + 12 * n)
    return doc, count, huffman.decode(body[at + 12 * n + 8 * b :], starts, m, table), first
