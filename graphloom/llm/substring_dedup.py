"""Substring dedup by difference-cover anchors.

A window is WINDOW words.  Of each text, only the short windows (anchors) that begin at the cover's places
modulo the period are hashed and sent: for any two equal windows some shift puts an anchor of both on
the cover, so a match of a whole window shares an anchor.  Around anchors that several texts share the match is
extended: the whole windows there are compared, by 128 bits over their words, and led to the first text in which they begin.

Texts stand in chunks of a bucketed table.  Hashes leave a chunk as sorted blobs, once for each chunk
however often they occur in it, and the answers come back to the chunk; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import Store
from ._text import U64, Block

#: Words of a window; the perfect difference cover {1, 2, 4} modulo 7 and the words of an anchor: 7 + 7 - 1 = 13.
WINDOW, PERIOD, COVER = 13, 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
#: Text bytes of a chunk; hashes that one task matches; parts beyond which only the hashes make more, as each chunk sends a row to each part.
CHUNK_BYTES, KEYS, PARTS = 4 << 20, 2_000_000, 600
_NO_ID = np.iinfo(np.int64).max
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rest, text) as chunks: chunk, rest (list), text (bytes end to end), offsets, null (one byte a text)."""
    from pyspark import TaskContext

    base, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def chunk() -> pa.RecordBatch:
        rest = pa.concat_arrays([b.column(0) for b in held])
        texts = pa.chunked_array([b.column(1) for b in held]).cast(pa.large_string()).combine_chunks()
        data, off = _text.buffers(texts)
        one = lambda x: pa.array([x], pa.binary())
        out = pa.record_batch({"chunk": pa.array([base + n], pa.int64()), "rest": pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest), "text": one(data.tobytes()), "offsets": one(off.astype("<i8").tobytes()), "null": one(np.asarray(pc.is_null(texts)).astype(np.uint8).tobytes())})
        held.clear()
        return out

    for batch in batches:
        for part in _text.blocks(batch, "text", CHUNK_BYTES):
            more = len(_text.buffers(part.column(1))[0])
            if held and size + more > CHUNK_BYTES:
                yield chunk()
                n, size = n + 1, 0
            held.append(part)
            size += more
    if held:
        yield chunk()


def _ids(rest: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(rest.field("id"), _NO_ID)).astype(np.int64)


def _opened(batch: pa.RecordBatch, i: int) -> tuple[pa.Array, np.ndarray, Block]:
    rest = batch.column("rest")[i].values
    return rest, _ids(rest), Block(np.frombuffer(batch.column("text")[i].as_py(), np.uint8), np.frombuffer(batch.column("offsets")[i].as_py(), "<i8").astype(np.int64))


def _anchors(words: _text.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the anchors on the cover, counted from the start of each text."""
    at = words.places(ANCHOR)
    doc = np.searchsorted(words.ptr, at, "right") - 1
    at = at[_ON_COVER[(at - words.ptr[doc]) % PERIOD]]
    return words.hashes(ANCHOR, at, 0), at  # these only choose where to look, so 40 bits of them will do


def _split(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash, by its high bits, so that sorted hashes have ascending parts."""
    return ((h >> U64(40)) * U64(parts) >> U64(24)).astype(np.int64)


def _parts(size: int, tasks: int) -> int:
    """Into how many parts hashes go: several a task for a small text, and for a large one as many as its bytes need."""
    return max(min(3 * tasks, PARTS), size // 6 * len(COVER) // PERIOD // KEYS)


def _unique(words: _text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h, at = _anchors(words)
    keys, back = np.unique(h & ~U64(0xFF), return_inverse=True)
    return keys, back, at, np.searchsorted(words.ptr, at, "right") - 1


def _send_anchors(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, block = _opened(batch, i)
                keys, back, _, doc = _unique(block.words())
                low, high = np.full(len(keys), _NO_ID), np.full(len(keys), -_NO_ID)
                np.minimum.at(low, back, ids[doc])
                np.maximum.at(high, back, ids[doc])
                yield _blobs(batch.column("chunk")[i].as_py(), parts, keys, {"keys": (keys >> U64(8)).astype("<u4"), "many": (low != high).astype(np.uint8)})

    return run


def _blobs(chunk: int, parts: int, keys: np.ndarray, values: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each part that has some of the ascending keys: part, chunk, and its stretch of every column as bytes."""
    part = _split(keys, parts)
    own, first = np.unique(part, return_index=True)
    cut = np.append(first, len(part)).tolist()
    cols = {"part": pa.array(own, pa.int32()), "chunk": pa.array(np.full(len(own), chunk), pa.int64())}
    return pa.record_batch(cols | {k: pa.array([v[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for k, v in values.items()})


def _match_anchors(table: pa.Table) -> pa.Table:
    """For each blob a byte a key: whether texts with different ids have it."""
    raw = table.column("keys").to_pylist()
    keys, many = np.frombuffer(b"".join(raw), "<u4"), np.frombuffer(b"".join(table.column("many").to_pylist()), np.uint8)
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    local = np.bincount(back, many) > 0
    shared = (n[back] > 1) | local[back]
    cut = np.cumsum([0, *(len(r) // 4 for r in raw)]).tolist()
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "bits": pa.array([np.packbits(shared[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


def _send_windows(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, block = _opened(batch, i)
                words = block.words()
                keys, back, at, _ = _unique(words)
                shared = np.zeros(len(keys), bool)
                _, first = np.unique(part := _split(keys, parts), return_index=True)
                cut = np.append(first, len(keys))
                told = {r["part"]: r["bits"] for r in batch.column("told")[i].as_py() or ()}
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    if (bits := told.get(int(part[a]))) is not None:
                        shared[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
                mark = np.zeros(len(words.start) + 1, np.int64)
                begin = at[shared[back]]
                np.add.at(mark, np.maximum(begin - (PERIOD - 1), 0), 1)
                np.add.at(mark, begin + 1, -1)
                near = np.cumsum(mark) > 0
                at = words.places(WINDOW)
                at = at[near[at]]
                own = ids[np.searchsorted(words.ptr, at, "right") - 1]
                at, own = at[own != _NO_ID], own[own != _NO_ID]
                x, y = words.hashes(WINDOW, at, 0), words.hashes(WINDOW, at, 1)
                first, back, _ = _text.classes(x, y, stable=False)
                low = np.full(len(first), _NO_ID)
                np.minimum.at(low, back, own)
                yield _blobs(batch.column("chunk")[i].as_py(), parts, x[first], {"keys": x[first].astype("<u8"), "more": y[first].astype("<u8"), "low": low.astype("<i8")})

    return run


def _match_windows(table: pa.Table) -> pa.Table:
    """For each blob a bit a key: whether it begins in a text with a smaller id than any of the chunk's that have it."""
    raw = table.column("keys").to_pylist()
    x, y, low = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("keys", "<u8"), ("more", "<u8"), ("low", "<i8")))
    first, back, _ = _text.classes(x, y)
    least = np.full(len(first), _NO_ID)
    np.minimum.at(least, back, low)
    earlier = least[back] < low
    cut = np.cumsum([0, *(len(r) // 8 for r in raw)]).tolist()
    bits = [_both(x[a:b][earlier[a:b]], y[a:b][earlier[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})


def _both(x: np.ndarray, y: np.ndarray) -> bytes:
    return np.stack([x, y], 1).astype("<u8").tobytes()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rest, ids, block = _opened(batch, i)
            words = block.words()
            x, y, at = words.windows(WINDOW)
            doc = np.searchsorted(words.ptr, at, "right") - 1
            own = ids[doc]
            known = own != _NO_ID
            x, y, at, own = x[known], y[known], at[known], own[known]
            told = np.frombuffer(b"".join(r["bits"] for r in batch.column("told")[i].as_py() or ()), "<u8").reshape(-1, 2)
            n = len(x)  # what the chunk was told stands behind its own windows, with an id below any
            first, back, _ = _text.classes(np.concatenate([x, told[:, 0]]), np.concatenate([y, told[:, 1]]), stable=False)
            low = np.full(len(first), _NO_ID)
            np.minimum.at(low, back, np.concatenate([own, np.full(len(told), -_NO_ID)]))
            gone = low[back[:n]] < own
            covered = _text.cover(at[gone], WINDOW, len(words.start))
            n_words = np.diff(words.ptr)
            removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[words.ptr])
            null = np.frombuffer(batch.column("null")[i].as_py(), np.uint8).astype(bool)
            raw, off = block.data.tobytes(), block.offsets.tolist()
            data, cut = _joined(block, words, ~covered)
            kept = pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
            for a in range(0, len(rest), 1024):
                b = min(a + 1024, len(rest))
                text = pa.array([None if null[j] else raw[off[j] : off[j + 1]] for j in range(a, b)], pa.binary()).cast(pa.string())
                yield pa.record_batch({"rest": rest.slice(a, b - a), "text": text, "n_words": pa.array(n_words[a:b], pa.int64()), "n_removed": pa.array(removed[a:b], pa.int64()), "kept_text": kept.slice(a, b - a).cast(pa.string())})


def _joined(block: Block, words: _text.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text, one blank between: bytes end to end and offsets."""
    start, end = words.start[keep], words.end[keep]
    size = end - start + 1
    done = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(start - done[:-1], size) + np.arange(done[-1])
    padded = np.append(block.data, np.uint8(0x20))
    out = padded[np.minimum(place, len(block.data))]
    out[done[1:] - 1] = 0x20
    ptr = np.concatenate([[0], np.cumsum(keep)])[words.ptr]
    lo, hi = done[ptr[:-1]], done[ptr[1:]]
    some = np.flatnonzero(hi > lo)
    out = np.delete(out, hi[some] - 1)  # the blank after a text's last word
    n = hi - lo - (hi > lo)
    return out, np.concatenate([[0], np.cumsum(n)])


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: list[str] | None = None, store: Store | None = None) -> DataFrame:
    """One row per row of docs: id, the columns of `carry`, text, n_words, n_removed, kept_text (kept words joined by one blank).

    Words are [^\\x20\\x09-\\x0D]+.  Removed is each word covered by a window whose words also begin a window of a text
    with a smaller id; windows are judged on the input.  Null text has no words.  Rows of one id do not
    remove each other's words; a row with a null id neither removes nor loses any.  A very long text is a chunk of its own, whole.
    Columns of docs that are not named play no part.  An empty table gives an empty one.
    """
    spark, carry, store = docs.sparkSession, carry or [], store or Store(docs.sparkSession)
    _text.small_batches(spark)
    own = docs.select(F.struct(F.col(id).cast("long").alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("rest"), F.col(text).alias("text"))
    kind = own.schema["rest"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = own.mapInArrow(_chunks, f"chunk long, rest array<{kind}>, text binary, offsets binary, null binary")
    chunks = store.bucketed(made, "chunks", parts, "chunk")
    size = chunks.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    split = _parts(size, parts)

    def answered(sent: DataFrame, match) -> DataFrame:
        told = sent.groupBy("part").applyInArrow(match, "chunk long, part int, bits binary")
        told = told.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias("told"))  # by chunk, as the table is: the join moves neither
        return chunks.join(told.hint("shuffle_merge"), "chunk", "left")

    sent = chunks.mapInArrow(_send_anchors(split), "part int, chunk long, keys binary, many binary")
    sent = answered(sent, _match_anchors).mapInArrow(_send_windows(split), "part int, chunk long, keys binary, more binary, low binary")
    done = answered(sent, _match_windows).mapInArrow(_removed, f"rest {kind}, text string, n_words long, n_removed long, kept_text string")
    return done.select(F.col("rest.id").alias(id), *[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(carry)], F.col("text").alias(text), "n_words", "n_removed", "kept_text")
