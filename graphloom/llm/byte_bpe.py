"""Byte-level BPE by Spark's higher-order functions.

Texts stand in chunks: the distinct words of a chunk, and for every text the numbers of its words.  The chunks' words meet
by hash in parts, where each distinct word of the corpus is folded once: the fold over a word's array of byte ranks merges, again and
again, the pair of lowest rank; the ranks of pairs are a literal two-choice hash table.  The ids go back to the chunks, once for
each word of a chunk; texts and their words' numbers never leave their chunk.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import Store
from ._text import Block

#: Text bytes of a chunk; words of chunks that meet in one task; words that are folded as one row.
CHUNK_BYTES, PART_WORDS, ROW_WORDS = 10 << 20, 400_000, 2_048
#: Stands for a pair without a rank.
NONE = (1 << 31) - 1
_SEEDS = (2_147_483_629, 1_640_531_527)


def ranks(path: str) -> list[bytes]:
    """The pieces of a rank file, by rank."""
    with open(path, "rb") as f:
        found = sorted((int(r), base64.b64decode(b)) for b, r in (line.split() for line in f if line.strip()))
    if [r for r, _ in found] != list(range(len(found))) or len(found) > 1 << 16:
        raise ValueError("ranks must run from 0 and fit 16 bits")
    return [b for _, b in found]


def pairs(pieces: list[bytes]) -> dict[int, int]:
    """For each pair of ranks (left << 16 | right) whose joined bytes have a rank: that rank, doubled, and one more if it may not be merged in many places at once.

    Many places at once are as good as the leftmost one again and again as long as no merge makes a pair of lower rank than its own: that is so
    for a piece that begins or ends only pieces of higher rank.
    """
    rank = {b: i for i, b in enumerate(pieces)}
    out, single = {}, set()
    for i, b in enumerate(pieces):
        for cut in range(1, len(b)):
            left, right = rank.get(b[:cut]), rank.get(b[cut:])
            if left is not None and right is not None:
                out[left << 16 | right] = i
                single.update(x for x in (left, right) if i < x)
    return {key: i << 1 | (i in single) for key, i in out.items()}


def pair_table(known: dict[int, int]) -> np.ndarray:
    """A two-choice table of pairs: (pair << 17 | value) or -1."""
    n = 5 * len(known) // 2 | 1
    while True:
        table = [-1] * n
        if all(_place(table, key << 17 | r) for key, r in known.items()):
            return np.array(table, np.int64)
        n = n * 9 // 8 | 1


def _slots(key: int, n: int) -> tuple[int, int]:
    return (key * _SEEDS[0] >> 12) % n, (key * _SEEDS[1] >> 12) % n


def _place(table: list[int], entry: int) -> bool:
    at = _slots(entry >> 17, len(table))[0]
    for _ in range(500):
        table[at], entry = entry, table[at]
        if entry < 0:
            return True
        one, two = _slots(entry >> 17, len(table))
        at = two if at == one else one
    return False


def fold(word: str, first: str, table: str, n: int) -> str:
    """SQL of the ranks into which an array of byte ranks merges; `first` has the values of its pairs.

    A step finds the lowest value and merges the leftmost pair that has it; or, where the value allows that and there are several, all of them, in
    a run of them every other one from its start.  A word's steps are as many as the different values it meets, however long its runs.
    """

    def slot(key: str, c: int) -> str:
        return f"{table}[cast(shiftright({key} * {c}L, 12) % {n}L as int)]"

    def value(a: str, b: str) -> str:
        key = f"(cast({a} as bigint) * 65536L + {b})"
        one, two = slot(key, _SEEDS[0]), slot(key, _SEEDS[1])
        return f"case when shiftright({one}, 17) = {key} then cast({one} & 131071L as int) when shiftright({two}, 17) = {key} then cast({two} & 131071L as int) else {NONE} end"

    def let(name: str, what: str, body: str) -> str:
        return f"transform(array({what}), {name} -> {body})[0]"

    none, made = "cast(array() as array<int>)", "shiftright(b, 1)"
    before = f"if(p > 1, array({value('acc.s[p - 2]', made)}), {none})"
    behind = f"if(p + 1 < size(acc.s), array({value(made, 'acc.s[p + 1]')}), {none})"
    one = f"named_struct('s', concat(slice(acc.s, 1, p - 1), array({made}), slice(acc.s, p + 2, size(acc.s))), 'r', concat(slice(acc.r, 1, greatest(p - 2, 0)), {before}, {behind}, slice(acc.r, p + 2, size(acc.r))))"
    touch = "exists(sequence(0, size(acc.r) - 2), i -> acc.r[i] = b and acc.r[i + 1] = b)"
    grown = "if(array_max(c) < shiftleft(1, k), c, transform(c, (x, i) -> if(x = shiftleft(1, k) and i >= shiftleft(1, k), x + c[i - shiftleft(1, k)], x)))"
    run = f"aggregate(if({touch}, sequence(0, 30), {none}), transform(acc.r, x -> if(x = b, 1, 0)), (c, k) -> {grown})"  # how many pairs of this value end here, one behind the other
    left = f"filter(transform(acc.s, (t, i) -> case when get(c, i) % 2 = 1 then {made} when i > 0 and c[i - 1] % 2 = 1 then -1 else t end), t -> t >= 0)"
    pairs_ = f"if(size(z) < 2, {none}, transform(slice(z, 1, size(z) - 1), (t, i) -> {value('t', 'z[i + 1]')}))"
    many = let("c", run, let("z", left, f"named_struct('s', z, 'r', {pairs_})"))
    again = "b % 2 = 0 and p < size(acc.r) and array_position(slice(acc.r, p + 1, size(acc.r)), b) > 0"
    merged = let("p", "cast(array_position(acc.r, b) as int)", f"if({again}, {many}, {one})")
    step = let("b", "array_min(acc.r)", f"if(b = {NONE}, named_struct('s', acc.s, 'r', {none}), {merged})")
    return f"if(size({word}) < 2, {word}, aggregate(sequence(2, size({word})), named_struct('s', {word}, 'r', {first}), (acc, x) -> if(size(acc.r) = 0, acc, {step}), acc -> acc.s))"


# ---------------------------------------------------------------- chunks, parts and back


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, all low bytes first, which compress better."""
    return x.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(kind, copy=False)


def _ends(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _gathered(flat: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of `flat` that begin at base, end to end."""
    done = _ends(size)
    return flat[np.repeat(base - done[:-1], size) + np.arange(done[-1])]


def _one(x: bytes) -> pa.Array:
    return pa.array([x], pa.binary())


def _chunks(limit: int):
    """Rows (id, text) as chunks: chunk, ids (list), counts (words of each text), order (number of each word), sizes and bytes of the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def chunk() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column(0) for b in held])
            known: dict[bytes, int] = {}
            counts, order = [], []
            for part in held:
                block = Block(*_text.buffers(part.column(1)))
                start, _ = _text.pretokens(block)
                number, words = block.tiles(start)
                own = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint32, len(words))
                order.append(own[number] if len(words) else own)
                counts.append(np.diff(block.owners(start)))
            order_ = np.concatenate(order)
            order.clear()
            often = np.argsort(-np.bincount(order_, minlength=len(known)), kind="stable")  # the most frequent get the least numbers
            rank = np.empty(len(often), np.uint32)
            rank[often] = np.arange(len(often))
            order_ = rank[order_]
            words = list(known)
            words = [words[i] for i in often.tolist()]
            out = pa.record_batch({
                "chunk": pa.array([base + n], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "counts": _one(_planes(np.concatenate(counts))),
                "order": _one(_planes(order_)), "sizes": _one(_planes(np.fromiter(map(len, words), np.int64, len(words)))), "words": _one(b"".join(words)),
            })
            held.clear()
            return out

        for batch in batches:
            for part in _text.blocks(batch, "text"):
                more = len(_text.buffers(part.column(1))[0])
                if held and size + more > limit:
                    yield chunk()
                    n, size = n + 1, 0
                held.append(part)
                size += more
        if held:
            yield chunk()

    return run


def _parted(sizes: np.ndarray, raw: bytes, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a chunk in order of their parts, and the part of each in that order."""
    cut = _ends(sizes).tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)), np.uint64, len(sizes))
    part = (h % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, part[order]


def _sent(parts: int):
    """A row for each part of which a chunk has words: part, chunk, sizes and bytes of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, raw = _numbers(batch.column("sizes")[i].as_py()), batch.column("words")[i].as_py()
                order, part = _parted(sizes, raw, parts)
                flat, base = np.frombuffer(raw, np.uint8), _ends(sizes)[:-1]
                own, first = np.unique(part, return_index=True)
                cols: dict[str, list] = {"sizes": [], "words": []}
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
                    at = order[a:b]
                    cols["sizes"].append(_planes(sizes[at]))
                    cols["words"].append(_gathered(flat, base[at], sizes[at]).tobytes())
                yield pa.record_batch({"part": pa.array(own, pa.int32()), "chunk": pa.array([batch.column("chunk")[i].as_py()] * len(own), pa.int64())} | {k: pa.array(v, pa.binary()) for k, v in cols.items()})
                del sizes, raw, order, part, flat, cols
                _text.trim()

    return run


def _lists(flat: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, pa.int32()))


def _met(byte_rank: np.ndarray, byte_pair: np.ndarray):
    """Of a part: its distinct words as byte ranks and values of pairs, ROW_WORDS a row; then for each chunk which of them are its own."""

    def run(table: pa.Table) -> pa.Table:
        part, chunks = table.column("part")[0].as_py(), table.column("chunk").to_pylist()
        sizes = [_numbers(x) for x in table.column("sizes").to_pylist()]
        data = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint8)
        number, words = Block(data, np.array([0, len(data)])).tiles(_ends(np.concatenate(sizes))[:-1])
        rows = []
        for at in range(0, len(words), ROW_WORDS):
            some = words[at : at + ROW_WORDS]
            raw = np.frombuffer(b"".join(some), np.uint8)
            cut = _ends(np.fromiter(map(len, some), np.int64, len(some)))
            inner = np.ones(len(raw), bool)
            inner[cut[1:] - 1] = False  # a word's last byte begins no pair
            first = byte_pair[raw[:-1], raw[1:]][inner[:-1]]
            rows.append((_lists(byte_rank[raw], cut), _lists(first, cut - np.arange(len(cut)))))
        cut = _ends(np.array([len(s) for s in sizes]))
        refs = [_planes(number[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        n, m = len(rows), len(chunks)
        ends = _ends(np.array([len(w) for w, _ in rows], np.int64)).tolist()
        off = pa.array([*ends[:-1], *[None] * m, ends[-1]], pa.int32())  # a chunk's row has no words
        nested = [pa.ListArray.from_arrays(off, pa.concat_arrays([r[i] for r in rows])) for i in (0, 1)]
        out = pa.table({"part": pa.array([part] * (n + m), pa.int32()), "chunk": pa.array([None] * n + chunks, pa.int64()), "refs": pa.array([None] * n + refs, pa.binary()), "words": nested[0], "firsts": nested[1]})
        del sizes, data, number, words, rows, refs, nested
        _text.trim()
        return out

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded words of a part, row by row, then its chunks: chunk, part, how many ids each of the chunk's words has, and the ids."""
    part, sizes, ids, whole = None, [], [], None
    for batch in batches:
        for i in range(batch.num_rows):
            if (now := batch.column("part")[i].as_py()) != part:
                part, sizes, ids, whole = now, [], [], None
                _text.trim()
            chunk = batch.column("chunk")[i].as_py()
            if chunk is None:
                words = batch.column("words")[i].values
                cut = np.asarray(words.offsets).astype(np.int64)
                sizes.append(np.diff(cut))
                ids.append(np.asarray(words.values)[cut[0] : cut[-1]].astype("<u2"))
                continue
            if whole is None:
                size = np.concatenate(sizes)
                whole = size, _ends(size)[:-1], np.concatenate(ids)
            size, base, flat = whole
            own = _numbers(batch.column("refs")[i].as_py())
            yield pa.record_batch({"chunk": pa.array([chunk], pa.int64()), "part": pa.array([part], pa.int32()), "sizes": _one(_planes(size[own])), "ids": _one(_gathered(flat, base[own], size[own]).tobytes())})


def _expanded(parts: int):
    """Chunks with what their words were told, as rows (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts, counts, order = batch.column("ids")[i].values, _numbers(batch.column("counts")[i].as_py()), _numbers(batch.column("order")[i].as_py(), np.uint32)
                place, _ = _parted(_numbers(batch.column("sizes")[i].as_py()), batch.column("words")[i].as_py(), parts)
                told = sorted(batch.column("told")[i].as_py() or (), key=lambda r: r["part"])
                size, base = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                if told:
                    own = np.concatenate([_numbers(r["sizes"]) for r in told])
                    size[place], base[place] = own, _ends(own)[:-1]
                flat = np.frombuffer(b"".join(r["ids"] for r in told), "<u2")
                ptr = _ends(counts)
                for a in range(0, len(counts), 512):  # a few texts at a time
                    b = min(a + 512, len(counts))
                    mine = order[ptr[a] : ptr[b]]
                    done = _ends(size[mine])
                    out = _gathered(flat, base[mine], size[mine]).astype(np.int32)
                    yield pa.record_batch({"id": texts.slice(a, b - a), "ids": pa.ListArray.from_arrays(pa.array(done[ptr[a : b + 1] - ptr[a]], pa.int32()), pa.array(out))})
                del order, place, told, flat, size, base
                _text.trim()

    return run


def _literal(values: np.ndarray, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast(f"array<{kind}>")


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, store: Store | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every whole text; null counts as empty and has no ids.

    Words of any length are folded alike.  Rows that repeat, null ids and other columns of any name make no difference; an empty table gives an empty one.
    """
    spark, store = docs.sparkSession, store or Store(docs.sparkSession)
    _text.small_batches(spark)
    pieces = ranks(path)
    known = pairs(pieces)
    table = pair_table(known)
    byte_rank = np.zeros(256, np.int32)
    for i, b in enumerate(pieces):
        if len(b) == 1:
            byte_rank[b[0]] = i
    byte_pair = np.full((256, 256), NONE, np.int32)
    for a in range(256):
        for b in range(256):
            byte_pair[a, b] = known.get(int(byte_rank[a]) << 16 | int(byte_rank[b]), NONE)
    kind = docs.schema[id].dataType.simpleString()
    made = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(_chunks(chunk_bytes), f"chunk long, ids array<{kind}>, counts binary, order binary, sizes binary, words binary")
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = store.bucketed(made, "chunks", shuffle, "chunk")
    words = chunks.agg(F.coalesce(F.sum(F.octet_length("sizes")), F.lit(0))).first()[0] // 4
    tasks = max(shuffle, -(-words // PART_WORDS))
    parts = 4 * tasks  # several a task, which evens out the tasks
    sent = chunks.mapInArrow(_sent(parts), "part int, chunk long, sizes binary, words binary")
    met = sent.repartition(tasks, "part").groupBy("part").applyInArrow(_met(byte_rank, byte_pair), "part int, chunk long, refs binary, words array<array<int>>, firsts array<array<int>>")
    folded = F.expr(f"transform(array(pairs), known -> zip_with(words, firsts, (w, f) -> {fold('w', 'f', 'known', len(table))}))[0]")
    done = met.withColumn("pairs", _literal(table, "bigint")).select("part", "chunk", "refs", folded.alias("words"))
    told = done.mapInArrow(_answered, "chunk long, part int, sizes binary, ids binary")
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("part", "sizes", "ids")).alias("told"))
    out = chunks.join(told.hint("shuffle_merge"), "chunk", "left").mapInArrow(_expanded(parts), f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id)


def decode(ids: Column, path: str) -> Column:
    """The bytes of an array of ids: its pieces end to end.  No ids give no bytes; null gives null, and an id without a piece is passed over."""
    pieces = F.split(F.lit(",".join(b.hex() for b in ranks(path))), ",")
    return F.unhex(F.array_join(F.element_at(F.transform(F.array(pieces), lambda p: F.transform(ids, lambda i: F.get(p, i))), 1), ""))
