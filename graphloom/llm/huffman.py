"""Canonical length-limited Huffman codes over ids, in vectorised form."""

from __future__ import annotations

import numpy as np

#: Bits of the longest code; the decoding table has 2 ** LIMIT entries.
LIMIT = 18
#: Ids of a block that is decoded on its own.
BLOCK = 1024


def lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of each id (0: never used), optimal under the limit, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of over {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, leaf = leaves, np.ones(len(leaves), bool)
    kept = [leaf]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        level, leaf = np.concatenate([leaves, pairs]), np.repeat([True, False], [len(leaves), len(pairs)])
        at = np.argsort(level, kind="stable")
        level, leaf = level[at], leaf[at]
        kept.append(leaf)
    need, size = 2 * (len(leaves) - 1), np.zeros(len(leaves), np.int64)
    for leaf in reversed(kept):
        own = int(leaf[:need].sum())
        size[:own] += 1
        need = 2 * (need - own)
    out[order] = size
    return out


def codes(length: np.ndarray) -> np.ndarray:
    """The canonical code of each id: ids in order of length, then of number."""
    out = np.zeros(len(length), np.uint64)
    used = np.flatnonzero(length)
    order = used[np.argsort(length[used], kind="stable")]
    size = length[order].astype(np.int64)
    if len(order):
        step = np.left_shift(np.int64(1), int(size.max()) - size)
        out[order] = ((np.cumsum(step) - step) >> (int(size.max()) - size)).astype(np.uint64)
    return out


def tables(length: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next `limit` bits: the id and the length of its code."""
    used = np.flatnonzero(length)
    order = used[np.argsort(length[used], kind="stable")]
    size = length[order].astype(np.int64)
    span = np.left_shift(np.int64(1), limit - size)
    ids, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.int64)
    ids[: span.sum()], bits[: span.sum()] = np.repeat(order, span), np.repeat(size, span)
    return ids, bits


def encode(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ids, and the bit offset at which each block of BLOCK ids begins."""
    size = length[ids].astype(np.int64)
    at = np.cumsum(size) - size
    total = int(at[-1] + size[-1]) if len(ids) else 0
    words = np.zeros(total // 64 + 3, np.uint64)
    if len(ids):
        bits, word, free = code[ids], at >> 6, 64 - (at & 63) - size
        whole = np.where(free >= 0, bits << np.maximum(free, 0).astype(np.uint64), bits >> np.maximum(-free, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.bitwise_or.reduceat(whole, first)
        over = np.flatnonzero(free < 0)
        words[word[over] + 1] |= bits[over] << (64 + free[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: total // 8 + 8], at[::BLOCK].copy()


def decode(stream: bytes, starts: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """The n ids of a stream; all blocks go forward together, each from its own bit offset."""
    by_bits, size = table
    raw = np.frombuffer(stream, np.uint8).astype(np.uint32)
    raw = np.concatenate([raw, np.zeros(8, np.uint32)])
    ahead = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    pos, out = starts.astype(np.int64).copy(), np.zeros((BLOCK, len(starts)), np.uint32)
    tail = n - BLOCK * (len(starts) - 1) if len(starts) else 0
    for i in range(BLOCK if len(starts) > 1 else tail):
        if i == tail:
            pos = pos[:-1]
        look = (ahead[pos >> 3] << (pos & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[i, : len(pos)] = by_bits[look]
        pos += size[look]
    return out.T.reshape(-1)[:n] if len(starts) else np.zeros(0, np.uint32)
