"""Exact dedup of texts without their white space, by an extendible-hash index on shared files.

Owner tasks hold ranges of 64-bit hashes.  An owner walks the hashes of its range in order, chains texts whose hashes collide and
compares their bytes.  Its directory leads from a hash's first bits behind the range's own to a bucket; a bucket that holds too much is
split in two, and the directory doubles where it is too small for that.  The index, bucket by bucket, is written to the shared folder.
Equal texts of one map task meet before they are sent, so a text with many copies is sent once a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._joins import left_join
from ._store import Store

#: Entries of a bucket; bytes of an owner's range, with so many for each entry beside its text; bytes of distinct texts that a map task compares at a time.
BUCKET_ENTRIES, OWNER_BYTES, ENTRY_BYTES, HELD_BYTES = 1_024, 64 << 20, 128, 16 << 20
_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def normalised(text: bytes) -> bytes:
    return text.translate(None, _SPACE)


class Directory:
    """Buckets of hashes by their first bits: 2 ** depth places, of which several lead to a bucket of less depth."""

    def __init__(self, capacity: int = BUCKET_ENTRIES):
        self.capacity, self.depth = capacity, 0
        self.buckets: list[list[int]] = [[]]
        self.local = [0]
        self.places = [0]

    def _place(self, key: int) -> int:
        return key >> (64 - self.depth) if self.depth else 0

    def insert(self, key: int) -> None:
        at = self.places[self._place(key)]
        self.buckets[at].append(key)
        while len(self.buckets[at]) > self.capacity and self.buckets[at][0] != self.buckets[at][-1] and self.local[at] < 64:
            if self.local[at] == self.depth:
                self.places = [p for p in self.places for _ in (0, 1)]  # the directory doubles
                self.depth += 1
            self._split(at)
            at = self.places[self._place(key)]

    def _split(self, at: int) -> None:
        held, local = self.buckets[at], self.local[at] + 1
        bit = 64 - local
        self.buckets[at] = [k for k in held if not k >> bit & 1]
        self.buckets.append([k for k in held if k >> bit & 1])
        self.local[at] = local
        self.local.append(local)
        first = self.places.index(at)
        n = 1 << (self.depth - local)
        self.places[first + n : first + 2 * n] = [len(self.buckets) - 1] * n

    def of(self, key: int) -> tuple[int, int]:
        """The bucket of a hash and its depth."""
        at = self.places[self._place(key)]
        return at, self.local[at]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row what decides: hash, digest, bytes; no text."""
    for batch in (part for whole in batches for part in _text.blocks(whole, "text")):
        data, off = _text.buffers(batch.column(1))
        raw = data.tobytes()
        text = [normalised(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        key = np.fromiter((xxhash.xxh64_intdigest(t) for t in text), np.uint64, len(text)).view(np.int64)
        yield pa.record_batch({"id": batch.column(0), "key": pa.array(key), "sha": pa.array([hashlib.sha256(t).digest() for t in text], pa.binary()), "bytes": pa.array([len(t) for t in text], pa.int64())})


def _better(points: int, id: int | None, than: tuple) -> bool:
    return (-points, id is None, id or 0) < (-than[0], than[1] is None, than[1] or 0)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list] = {}  # the bytes themselves are compared
    size = 0

    def sent() -> pa.RecordBatch:
        key = np.fromiter((xxhash.xxh64_intdigest(t) for t in held), np.uint64, len(held))
        cols = list(zip(*held.values(), strict=True))
        return pa.record_batch({"key": pa.array(key.view(np.int64)), "text": pa.array(list(held), pa.binary()), "points": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int64())})

    for batch in (part for whole in batches for part in _text.blocks(whole, "text")):
        data, off = _text.buffers(batch.column(1))
        points = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]).tolist()
        raw = data.tobytes()
        for i, (a, b, id) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), batch.column(0).to_pylist(), strict=True)):
            text = normalised(raw[a:b])
            have = held.get(text)
            if have is None:
                if size + len(text) > HELD_BYTES and held:
                    yield sent()
                    held, size = {}, 0
                held[text] = [points[i], id, 1]
                size += len(text)
            else:
                have[2] += 1
                if _better(points[i], id, have):
                    have[:2] = points[i], id
    if held:
        yield sent()


def _inside(key: int, owners: int) -> int:
    """The bits of a hash behind those that choose its owner."""
    return ((key >> 32 & 0xFFFFFFFF) * owners & 0xFFFFFFFF) << 32 | key & 0xFFFFFFFF


def _owner(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _indexed(batches, owners)

    return run


def _indexed(batches: Iterator[pa.RecordBatch], owners: int) -> Iterator[pa.RecordBatch]:
    """Walks a range of sorted hashes, the texts of one hash at a time; then gives the range's index, bucket by bucket.

    What it holds of a text is a digest and three numbers.
    """
    directory, key, chain, out = Directory(), None, {}, []

    def closed() -> None:
        for place, (text, one) in enumerate(chain.items()):
            directory.insert(_inside(key, owners))
            out.append((key, place, hashlib.sha256(text).digest(), one[1], one[2]))

    for batch in (part for whole in batches for part in _text.blocks(whole, "text")):
        for k, text, points, id, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if k != key:
                if chain:
                    closed()
                key, chain = k, {}
            have = chain.get(text)  # a dict compares bytes wherever hashes agree
            if have is None:
                chain[text] = [points, id, n]
            else:
                have[2] += n
                if _better(points, id, have):
                    have[:2] = points, id
    if chain:
        closed()
    kinds = {"bucket": pa.int32(), "depth": pa.int32(), "key": pa.int64(), "chain": pa.int32(), "sha": pa.binary(), "keep_id": pa.int64(), "n": pa.int64()}
    rows = sorted((*directory.of(_inside(r[0], owners)), *r) for r in out)
    for at in range(0, len(rows), 16 * BUCKET_ENTRIES):
        cols = zip(*rows[at : at + 16 * BUCKET_ENTRIES], strict=True)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", store: Store | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (hex, of the text without [\\x20\\x09-\\x0D]).

    Null text counts as empty, so null, empty and blank texts are one group.  Of equal texts the row with the
    most code points stays, then the smallest id; null ids come last.  Rows that repeat one id share
    its verdict and each count in group_size.  Other columns play no part; an empty table gives an empty one.
    """
    spark, store = docs.sparkSession, store or Store(docs.sparkSession)
    _text.small_batches(spark)
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = store.written(own.mapInArrow(_rows, "id long, key long, sha binary, bytes long"), "hashes")
    total = rows.agg(F.sum(F.col("bytes") + ENTRY_BYTES)).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNER_BYTES))
    entries = own.mapInArrow(_texts, "key long, text binary, points long, id long, n long")
    owner = F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * owners, 32).cast("int")  # an even range of hashes
    owned = entries.repartitionById(owners, owner).sortWithinPartitions("key").mapInArrow(_owner(owners), "bucket int, depth int, key long, chain int, sha binary, keep_id long, n long")
    index = store.written(owned.select(F.spark_partition_id().alias("owner"), "*"), "index")
    joined = left_join(rows.select("id", "key", "sha"), index.select("key", "sha", "keep_id", "n"), ["key", "sha"], held="n")
    return joined.select(F.col("id").alias(id), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
