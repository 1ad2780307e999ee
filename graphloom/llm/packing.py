"""Hierarchical residual packing of texts into sequences of at most `size` tokens.

Pieces are packed best-fit within leaves; nearly full bins leave, and the underfull ones of several
leaves meet as items of a further best-fit round, up a tree whose nodes hold NODE bins each.  A bin that is too full for the
least bin left leaves as well, for nothing can join it.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import Store
from .token_files import encoding, id_type

#: Pieces of a leaf; underfull bins that meet in one node; share of a sequence from which it counts as full.
LEAF, NODE, FULL = 16_384, 65_536, 0.99


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, largest items first, each into the fullest bin that takes it; and the bins' fills."""
    bin_, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    mask = 0  # bit f: some bin has f free
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        above = mask >> n
        if above:
            free = n + (above & -above).bit_length() - 1
            b = open_[free].pop()
            if not open_[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bin_[i], offset[i] = b, fill[b]
        fill[b] += n
        left = free - n
        if left:
            open_[left].append(b)
            mask |= 1 << left
    return bin_, offset, fill


def pieces(docs: DataFrame, path: str, end: int, size: int = 2048, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids: every text's ids with `end`; those over `size` cut so that all pieces but the first are full.

    Null and empty texts are one piece, `end` alone.  Rows that repeat and null ids each have pieces of their own; other
    columns play no part, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encode(batches):
            ids, off = _text.buffers(batch.column(2))
            n = np.diff(off) // width
            count = -(-n // size)
            owner = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            first = n - (count - 1) * size
            begin = np.where(piece == 0, 0, first[owner] + (piece - 1) * size)
            length = np.where(piece == 0, first[owner], size)
            at = off[:-1][owner] + begin * width
            raw = [ids[a:b] for a, b in zip(at.tolist(), (at + length * width).tolist(), strict=True)]
            crc = [zlib.crc32(x.view(kind).astype("<u4").tobytes()) for x in raw]
            yield pa.record_batch({"doc_id": batch.column(0).take(pa.array(owner)), "piece": pa.array(piece, pa.int32()), "start": pa.array(begin, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "ids": pa.array([x.tobytes() for x in raw], pa.binary())})

    from tokenizers import Tokenizer

    _text.one_thread()
    kind = id_type(Tokenizer.from_file(path).get_vocab_size())
    width, encode = kind.itemsize, encoding(path, end)
    _text.small_batches(docs.sparkSession)
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def pack(items: DataFrame, size: int = 2048, store: Store | None = None) -> DataFrame:
    """items (a written table with `length`, 1 to size) with sequence_id and offset; columns called item, leaf or bin are refused.

    An item's place in the table decides its leaf, so equal rows spread like any others.  Each round's
    result is written, and the next reads it.  The rounds end with one node, or when so many bins are left that the next round would have as many nodes
    as the last: then bins of NODE others each have found none to join.  An empty table gives an empty one.
    """
    if clash := {"item", "leaf", "bin", "base", "sequence_id", "offset"} & set(items.columns):
        raise ValueError(f"columns {sorted(clash)} would be hidden")
    spark, store = items.sparkSession, store or Store(items.sparkSession)
    n = items.count()
    leaves = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAF)), max(1, -(-n // (LEAF // 4))))
    rest = [c for c in items.columns if c != "ids"]
    placed = items.select(*rest).withColumn("leaf", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(leaves)))

    def local(k: tuple, table: pa.Table) -> pa.Table:
        bin_, offset, _ = best_fit(table.column("length").to_numpy(), size)
        return table.append_column("bin", pa.array((k[0].as_py() << 32) + bin_)).append_column("base", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields) + ", bin long, base long"
    placed = store.written(placed.groupBy("leaf").applyInArrow(lambda k, t: local(k, t), schema), "packed")
    tops = placed.groupBy("leaf", "bin").agg(F.sum("length").alias("fill")).select(F.col("bin").alias("now"), "fill", F.col("leaf").cast("long").alias("node"))
    bins, level, nodes = tops.select(F.col("now").alias("bin"), "now", F.lit(0).cast("long").alias("add")), 0, leaves

    def merge(level: int, k: tuple, table: pa.Table) -> pa.Table:
        fill, now = table.column("fill").to_numpy(), table.column("now").to_numpy()
        order = np.lexsort((now, fill))
        b, offset, filled = best_fit(fill[order], size)
        return pa.table({"now": now[order], "to": (level << 56) + (k[0].as_py() << 32) + b, "more": offset, "fill": np.array(filled, np.int64)[b], "node": np.full(len(order), k[0].as_py(), np.int64)})

    while nodes > 1:
        level += 1
        under = tops.where(F.col("fill") < int(size * FULL))
        least = under.agg(F.min("fill")).first()[0]
        if least is None:
            break
        under = under.where(F.col("fill") <= size - least)
        left = under.count()
        fewer = -(-left // NODE)
        if left == 0 or fewer >= nodes:
            break
        under = under.withColumn("node", F.floor(F.col("node") * fewer / nodes).cast("long"))
        step, nodes = functools.partial(merge, level), fewer
        moved = store.written(under.groupBy("node").applyInArrow(lambda k, t: step(k, t), "now long, to long, more long, fill long, node long"), "bins")
        bins = bins.join(moved.select("now", "to", "more"), "now", "left").select("bin", F.coalesce("to", "now").alias("now"), (F.col("add") + F.coalesce("more", F.lit(0))).alias("add"))
        tops = moved.select(F.col("to").alias("now"), "fill", "node").distinct()
    out = placed.join(bins, "bin")
    return out.select(*rest, F.col("now").alias("sequence_id"), (F.col("base") + F.col("add")).alias("offset"))
