"""Encoding of whole texts by a byte-level vocabulary of the tokenizers library.

A text is split into pre-tokens in vectorised form; the library encodes each pre-token that the
worker has not met, and a bounded cache of the worker holds what it gave.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from . import _text
from ._text import Block

#: Pre-tokens, and bytes of them, that a worker holds at most; beyond either the cache starts anew.
CACHE_WORDS, CACHE_BYTES = 400_000, 32 << 20
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str):
        _text.one_thread()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: Whether the split by pre-tokens holds for this vocabulary; any other is left to the library whole.
        self.split = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["normalizer"] is None and spec["post_processor"] is None and spec["truncation"] is None and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self._word = self.library.model.tokenize
        self._chars = _text.byte_chars()
        self._reset()

    def _reset(self) -> None:
        self._known: dict[bytes, int] = {}
        self._held = 0
        self._ids, self._n_ids = np.zeros(1 << 20, np.uint32), 0
        self._off, self._n = np.zeros(1 << 18, np.int64), 0

    def _store(self, words: list[bytes], ids: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for word in ids for x in word), np.uint32, int(sizes.sum()))
        while self._n_ids + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while self._n + len(sizes) + 1 > len(self._off):
            self._off = np.concatenate([self._off, np.zeros_like(self._off)])
        self._ids[self._n_ids : self._n_ids + len(flat)] = flat
        self._off[self._n + 1 : self._n + 1 + len(sizes)] = self._n_ids + np.cumsum(sizes)
        at = np.arange(self._n, self._n + len(sizes))
        self._known.update(zip(words, at.tolist(), strict=True))
        self._held += sum(map(len, words))
        self._n += len(sizes)
        self._n_ids += len(flat)
        return at

    def _places(self, words: list[bytes]) -> np.ndarray:
        """The place in the cache of each of some distinct pre-tokens; they are found by their bytes."""
        if self._n > CACHE_WORDS or self._held > CACHE_BYTES:
            self._reset()
        known = self._known
        out = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(out < 0)
        if len(new):
            chars, tokenize = self._chars, self._word
            met = [words[i] for i in new.tolist()]
            out[new] = self._store(met, [[t.id for t in tokenize(w.decode("latin-1").translate(chars))] for w in met])
        return out

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        ptr = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=ptr[1:])
        return np.fromiter((x for one in ids for x in one), np.uint32, int(ptr[-1])), ptr

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column end to end, and the n + 1 places at which each text's begin."""
        if not self.split:
            return self._whole([x or "" for x in col.to_pylist()])
        data, off = _text.buffers(col)
        raw = data.tobytes()
        held = [s for s in self.special if s.encode() in raw]
        if not held:
            return self._encode(data, off)
        # Texts that name a special token: the pieces between are texts of their own, the names are ids.
        import re

        cut, names = re.compile("|".join(re.escape(s) for s in sorted(held, key=len, reverse=True))), self.special
        parts, owner = [], []
        for i, text in enumerate(col.to_pylist()):
            text, at = text or "", 0
            for m in cut.finditer(text):
                parts += [text[at : m.start()], m[0]]
                at = m.end()
            parts.append(text[at:])
            owner += [i] * (len(parts) - len(owner))
        special = np.array([names.get(p, -1) for p in parts], np.int64)
        ids, ptr = self._encode(*_text.buffers(pa.array(["" if s >= 0 else p for p, s in zip(parts, special, strict=True)], pa.large_string())))
        count = np.diff(ptr) + (special >= 0)
        ids = np.insert(ids, ptr[:-1][special >= 0], special[special >= 0].astype(np.uint32))
        per = np.bincount(owner, count, minlength=len(col)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per)])

    def _encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = Block(data, off)
        start, _ = _text.pretokens(block)
        number, words = block.tiles(start)
        at = self._places(words)[number] if words else np.zeros(0, np.int64)
        base = self._off[at]
        size = self._off[at + 1] - base
        done = np.concatenate([[0], np.cumsum(size)])
        ids = self._ids[np.repeat(base - done[:-1], size) + np.arange(done[-1])]
        return ids, done[block.owners(start)]

    def sizes(self, words: list[bytes]) -> np.ndarray:
        """How many ids each of some distinct pre-tokens has."""
        at = self._places(words)
        return self._off[at + 1] - self._off[at]

    def counts(self, col: pa.Array) -> np.ndarray:
        _, ptr = self.encode(col)
        return np.diff(ptr)
