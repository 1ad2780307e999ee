"""Vectorised splitting of whole texts held in Arrow buffers; pieces are told apart by their bytes, windows of them by 128 bits.

Everything here works on one block of texts at a time: the UTF-8 bytes of all texts of the
block end to end, and the offsets at which they begin.  No text is cut short.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Bytes of text in one block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(33))
        h *= U64(0xFF51AFD7ED558CCD)
        h ^= h >> U64(33)
        h *= U64(0xC4CEB9FE1A85EC53)
        h ^= h >> U64(33)
    return h


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take `limit` bytes at most, or hold one row."""
    col = batch.column(batch.schema.get_field_index(text))
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64) if len(col) else np.zeros(0, np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(size):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    trim()


class Block:
    """Texts end to end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets

    def tiles(self, start: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The stretches of bytes from each start to the next (the last to the end), told apart by their bytes: the number of each, and the distinct ones by number."""
        if not len(start):
            return np.zeros(0, np.int32), []
        off = pa.py_buffer(np.append(start, len(self.data)).astype(np.int64))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, off, pa.py_buffer(np.ascontiguousarray(self.data))]).dictionary_encode()
        data, cut = buffers(coded.dictionary)
        raw, cut = data.tobytes(), cut.tolist()
        return np.asarray(coded.indices), [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def words(self) -> Words:
        return Words(self)

    def owners(self, starts: np.ndarray) -> np.ndarray:
        """For the n texts, n + 1 places in a sorted list of byte positions."""
        return np.searchsorted(starts, self.offsets, "left")


def digests(pieces: list[bytes]) -> np.ndarray:
    """128 bits for each piece, as two columns of 64."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), U64).reshape(-1, 2)


def renumbered(number: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of pieces, some of which may be equal, as numbers of the distinct ones; and these."""
    known: dict[bytes, int] = {}
    own = np.fromiter((known.setdefault(p, len(known)) for p in pieces), np.int32, len(pieces))
    return own[number] if len(pieces) else number, list(known)


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a block: byte spans, the number of each (equal for equal bytes), and each text's range of them."""

    def __init__(self, block: Block):
        data, off = block.data, block.offsets
        n = len(data)
        space = _WS[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        first, last = ~space, ~space
        if n:
            first[1:] &= space[:-1] | edge[1:-1]
            last[:-1] &= space[1:] | edge[1:-1]
        self.block, self.start, self.end = block, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ptr = block.owners(self.start)
        size = self.end - self.start
        self.number, self.distinct = Block(data[~space], block.offsets).tiles(np.cumsum(size) - size)  # without white space, words are end to end
        self._lanes: np.ndarray | None = None

    @property
    def lanes(self) -> np.ndarray:
        """128 bits for each distinct word."""
        if self._lanes is None:
            self._lanes = digests(self.distinct)
        return self._lanes

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def places(self, k: int) -> np.ndarray:
        """The places at which a window of k words begins that lies in one text."""
        m = len(self.number) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        ok = np.ones(m, bool)
        cut = self.ptr[1:-1]  # a window from cut-k+1 .. cut-1 would cross the border
        for d in range(1, k):
            x = cut - d
            ok[x[(x >= 0) & (x < m)]] = False
        return np.flatnonzero(ok)

    def hashes(self, k: int, at: np.ndarray, lane: int) -> np.ndarray:
        """Of the 128 bits of the k-word windows that begin at the places, one half."""
        m = len(self.number) - k + 1
        if not len(at):
            return np.zeros(0, U64)
        few = 3 * len(at) < m
        h = np.ascontiguousarray(self.lanes[:, lane])[self.number]
        w = np.zeros(len(at) if few else m, U64)
        with np.errstate(over="ignore"):
            for d in range(k):  # a factor of its own for each place
                w += (h[at + d] if few else h[d : d + m]) * _PLACES[lane, d]
        return mix(w if few else w[at])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """128 bits (two arrays of 64) for each k-word window that lies in one text, and the places at which they begin."""
        at = self.places(k)
        return self.hashes(k, at, 0), self.hashes(k, at, 1), at


#: Odd factors of the places of a window, for either half of its 128 bits.
_PLACES = np.random.default_rng(20_240).integers(0, 1 << 63, (2, 64), dtype=U64) * U64(2) + U64(1)


def classes(a: np.ndarray, b: np.ndarray, stable: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (a, b) of 128 bits told apart: the first row (if not stable, any row) of each class in order of a, each row's class, and the classes' sizes."""
    order = np.argsort(a, kind="stable" if stable else None)
    x, y = a[order], b[order]
    if len(x) > 1 and ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    number = np.cumsum(new) - 1
    back = np.empty(len(x), np.int64)
    back[order] = number
    at = np.flatnonzero(new)
    return order[at], back, np.diff(np.append(at, len(x)))


def cover(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that begins at one of the places."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, at, 1) if len(at) and len(np.unique(at)) < len(at) else mark.__setitem__(at, 1)
    run = np.cumsum(mark[:n])
    run[k:] -= np.cumsum(mark[: max(0, n - k)]) if n > k else 0
    return run > 0


# ---------------------------------------------------------------- pre-tokens

_classes: list[np.ndarray] = []
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def char_classes() -> np.ndarray:
    """For each code point: letter, number, white space or other, as the pre-token pattern has them."""
    if not _classes:
        import regex

        table = np.zeros(0x110000, np.uint8)
        every = np.arange(0x110000, dtype=np.uint32)
        every[0xD800:0xE000] = 0xFFFF
        text = every.astype("<u4").tobytes().decode("utf-32-le")
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                table[m.start() : m.end()] = kind
        table[[0x1C, 0x1D, 0x1E, 0x1F]] = _OTHER  # not White_Space
        _classes.append(table)
    return _classes[0]


def pretokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the matches of the byte-level pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ in every text."""
    data, n, table = block.data, len(block.data), char_classes()
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.int64)
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        x = [data[np.minimum(lead + i, n - 1)].astype(np.int64) & 0x3F for i in (1, 2, 3)]
        point = np.where(size == 2, (b & 0x1F) << 6 | x[0], np.where(size == 3, (b & 0x0F) << 12 | x[0] << 6 | x[1], (b & 0x07) << 18 | x[0] << 12 | x[1] << 6 | x[2]))
        own = table[point]
        kind[lead] = own
        for i in (1, 2, 3):
            more = size > i
            kind[lead[more] + i] = own[more]
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    start = edge[:n].copy()
    start[0] = True
    start[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(start)
    # a run after white space in the same text takes a last plain blank; any other last blank is a token
    after = run[1:][(kind[run[1:]] != _SPACE) & (kind[run[1:] - 1] == _SPACE) & ~edge[run[1:]]]
    blank = data[after - 1] == 0x20
    start[after[blank]] = False
    start[after[blank] - 1] = True
    odd = after[~blank] - 1
    while len(odd) and (tail := (data[odd] & 0xC0) == 0x80).any():
        odd = odd - tail
    start[odd] = True
    # contractions: an apostrophe alone between a token's start and a letter
    quote = np.flatnonzero((data == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~edge[quote + 1]]
    if len(quote):
        one, two = data[quote + 1], data[np.minimum(quote + 2, n - 1)]
        inside = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
        long = inside & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        took = long | short
        start[quote[took] + 1] = False
        ends = quote[took] + np.where(long[took], 3, 2)
        start[ends[ends < n]] = True
    begin = np.flatnonzero(start)
    return begin, np.append(begin[1:], n)


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    out |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}
    return out


def trim() -> None:
    """Gives memory that a worker has freed back to the machine, for it lives on beside other workers."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark) -> None:
    """Bounds what an Arrow batch holds in the JVM and in a worker; a longer text is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def one_thread() -> None:
    """Keeps native libraries from starting threads beside Spark's tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
