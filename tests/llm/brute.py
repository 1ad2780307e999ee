"""Plain versions of the contracts, row by row, for small tables."""

import collections
import hashlib
import re
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def ids(texts, end=None):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + ([end] if end is not None else []) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def token_files(docs):
    out, at = [], 0
    docs = sorted(docs)
    for (doc, _), x in zip(docs, ids([t for _, t in docs], 2), strict=True):
        out.append((doc, at, len(x), crc(x)))
        at += len(x)
    return out


def quality(text):
    w = words(text)
    text = text or ""
    lines = [x for x in text.split("\n") if words(x)]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            rep |= set(range(i, i + 5))
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)


def exact(docs):
    groups = collections.defaultdict(list)
    for doc, text in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc, text or ""))
    out = []
    for norm, rows in groups.items():
        keep = min(rows, key=lambda r: (-len(r[1]), r[0]))[0]
        out += [(doc, keep, len(rows), doc == keep, hashlib.sha256(norm.encode()).hexdigest()) for doc, _ in rows]
    return out


def substring(docs, k=13):
    first = {}
    for doc, text in sorted(docs):
        w = words(text)
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), doc)
    out = []
    for doc, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < doc:
                gone |= set(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k=4):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(docs):
    sets = {doc: shingles(text) for doc, text in docs}
    holders = collections.defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            holders[x].append(doc)
    parent = {doc: doc for doc in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, s in sets.items():
        common = collections.Counter(b for x in s for b in holders[x] if b > a)
        for b, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [(doc, len(s), find(doc), find(doc) == doc) for doc, s in sets.items()]


def byte_bpe(docs):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for doc, text in docs:
        x = t.encode_ordinary(text or "")
        out.append((doc, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.decode_bytes(x)).hexdigest()))
    return out
