"""Parts of the operators on their own: codes, covers, tables, forests, directories, splits."""

import collections
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import _text, _tokens, byte_bpe, exact_dedup, huffman, near_dedup, packing, quality_rules, substring_dedup


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000))
def test_huffman_round_trip(ids):
    ids = np.array(ids, np.int64)
    length = huffman.lengths(np.bincount(ids, minlength=301))
    stream, starts = huffman.encode(ids, huffman.codes(length), length)
    assert np.array_equal(huffman.decode(stream, starts, len(ids), huffman.tables(length)), ids)


def test_huffman_limit_and_size():
    counts = np.array([2**i for i in range(40)])
    length = huffman.lengths(counts, 12)
    assert length.max() == 12 and sum(2.0 ** -length.astype(float)) <= 1
    even = huffman.lengths(np.ones(256, np.int64))
    assert set(even.tolist()) == {8}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab's tlrevmd \n\t'é中 　 12²́!?\x1c\x85👍", max_size=40), max_size=8))
def test_pretokens(texts):
    block = _text.Block(*_text.buffers(pa.array(texts, pa.string())))
    start, end = _text.pretokens(block)
    raw = block.data.tobytes()
    number, pieces = block.tiles(start)
    assert [pieces[i] for i in number] == [raw[a:b] for a, b in zip(start, end)] and len(set(pieces)) == len(pieces)
    assert [raw[a:b].decode() for a, b in zip(start, end)] == [w for t in texts for w in regex.findall(public_tokenizers.PATTERN, t)]
    words = block.words()
    assert [raw[a:b] for a, b in zip(words.start, words.end)] == [w for t in texts for w in t.encode().split()]


def test_encoder_matches_library():
    enc = _tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = ["".join(rng.choice(["the ", "x", "'s", "\n", "é", "<|endoftext|>", "12 "]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None]
    ids, ptr = enc.encode(pa.array(texts))
    want = [e.ids for e in enc.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:])] == want


def test_other_vocabulary_is_left_to_the_library():
    enc = _tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    ids, ptr = enc.encode(pa.array(["Some Words", None]))
    assert not enc.split and ids[: ptr[1]].tolist() == enc.library.encode("Some Words", add_special_tokens=False).ids


def test_every_shift_meets_the_cover():
    for a in range(substring_dedup.PERIOD):
        for b in range(substring_dedup.PERIOD):
            assert any((a + s) % 7 in substring_dedup.COVER and (b + s) % 7 in substring_dedup.COVER for s in range(7))
    assert substring_dedup.ANCHOR + substring_dedup.PERIOD - 1 == substring_dedup.WINDOW


def test_pair_table():
    pieces = byte_bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = byte_bpe.pairs(pieces)
    table, rank = byte_bpe.pair_table(known), {b: i for i, b in enumerate(pieces)}
    rng = random.Random(0)
    for _ in range(2000):
        a, b = rng.randrange(len(pieces)), rng.randrange(300)
        key, want = a << 16 | b, rank.get(pieces[a] + pieces[b])
        found = [int(table[s]) & 131071 for s in byte_bpe._slots(key, len(table)) if table[s] >= 0 and int(table[s]) >> 17 == key]
        assert [f >> 1 for f in found[:1]] == ([] if want is None else [want])


def test_fold_of_any_length(spark):
    """Long runs, words of few letters and words of many: as the library has them."""
    from . import brute

    rng = random.Random(4)
    texts = ["x" * 100_000, "-" * 4_999 + "=" * 778, None, "", "".join(rng.choice("acgt") for _ in range(3_000)), "".join(rng.choice("abcdefghijklmnop") for _ in range(600))]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for letters in ("ation", "the nd", "ab", "- =*", "xXx", "é中a") for _ in range(10)]
    docs = list(enumerate(texts))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(spark.createDataFrame(docs, "doc_id long, text string"), path, chunk_bytes=20_000)
    named = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    rows = ids.select("doc_id", F.size("ids"), named, F.sha2(byte_bpe.decode(F.col("ids"), path), 256)).collect()
    assert sorted(map(tuple, rows)) == brute.byte_bpe(docs)


def test_directory_doubles_and_splits_only_what_is_full():
    rng = random.Random(2)
    keys = [rng.getrandbits(64) for _ in range(3_000)] + [7] * 40 + [rng.getrandbits(50) for _ in range(300)]
    d = exact_dedup.Directory(16)
    for k in keys:
        d.insert(k)
    assert len(d.places) == 1 << d.depth and sorted(x for b in d.buckets for x in b) == sorted(keys)
    for at, held in enumerate(d.buckets):
        assert len(set(held)) <= 1 or len(held) <= 16
        assert {k >> (64 - d.local[at]) for k in held} <= {held[0] >> (64 - d.local[at])} if held and d.local[at] else True
        assert all(d.of(k) == (at, d.local[at]) for k in held)


def test_owner_chains_hashes_that_collide(monkeypatch):
    """Two texts of one hash are two entries of a chain."""
    rows = [(5, b"one", 3, 1, 1), (5, b"two", 3, 2, 2), (5, b"one", 4, 9, 1), (6, b"six", 3, 4, 1)]
    cols = dict(zip(("key", "text", "points", "id", "n"), zip(*rows), strict=True))
    batch = pa.record_batch({"key": pa.array(cols["key"], pa.int64()), "text": pa.array(cols["text"], pa.binary())} | {c: pa.array(cols[c], pa.int64()) for c in ("points", "id", "n")})
    out = [r for b in exact_dedup._owner(3)(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["key"], r["chain"], r["keep_id"], r["n"]) for r in out) == [(5, 0, 9, 2), (5, 1, 2, 2), (6, 0, 4, 1)]


def test_best_fit():
    sizes = np.array([6, 5, 4, 3, 2])
    bin_, offset, fill = packing.best_fit(sizes, 10)
    assert sorted(fill) == [10, 10] and len({*zip(bin_.tolist(), offset.tolist())}) == 5


def test_shared_shingles_are_exact():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = (np.unique(rng.integers(0, 200, rng.integers(0, 150)).astype(np.uint64)) for _ in range(2))
        other = np.where(rng.random(len(b)) < 0.1, np.uint64(1), np.uint64(0))  # half a hash alone is no match
        want = len(np.intersect1d(a, b[other == 0]))
        assert near_dedup.common((a, np.zeros_like(a)), (b, other)) == want


def test_classes_look_at_all_bits():
    a, b = np.array([5, 5, 5, 2], np.uint64), np.array([1, 2, 1, 2], np.uint64)
    first, back, size = _text.classes(a, b)
    assert back[0] == back[2] != back[1] and size[back[0]] == 2 and len(first) == 3


def test_rules_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.fit(docs, labels.where("doc_id % 2 = 0"))
    seen = collections.Counter((r.quality, r.kept) for r in quality_rules.judge(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), rules).where("not base_failed").collect())
    assert seen[1, True] >= 0.97 * (seen[1, True] + seen[1, False])
    assert seen[0, False] >= 0.9 * (seen[0, True] + seen[0, False])


def test_labels_that_contradict_each_other(spark):
    """The bad label holds, in whatever order the rows come; null labels, null texts and empty labels are no trouble."""
    docs = spark.createDataFrame([(i, "word " * (3 if i % 2 else 60)) for i in range(60)] + [(99, None)], "doc_id long, text string")
    labels = [(i, i % 2 ^ 1) for i in range(60)] + [(i, 1) for i in range(60)] + [(99, None), (None, 0)]
    fitted = [quality_rules.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, labels[::-1])]
    assert fitted[0] == fitted[1] != []
    assert quality_rules.fit(docs, spark.createDataFrame([], "doc_id long, quality int")) == []


def test_rules_without_one_kind():
    x = {"words": np.arange(10.0)}
    assert quality_rules.learn(x, np.zeros(10, bool)) == []


def test_a_chunk_of_words_takes_little_memory(monkeypatch):
    """Workers live beside the JVM and other workers, so a chunk may hold a few times its text only."""
    import tracemalloc
    import types

    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(50_000)])
    batches = [pa.record_batch({"id": pa.array(range(16)), "text": pa.array([" ".join(words[rng.integers(0, len(words), 10_000)]) for _ in range(16)])}) for _ in range(20)]
    tracemalloc.start()
    try:
        chunks = sum(c.num_rows for c in byte_bpe._chunks(byte_bpe.CHUNK_BYTES)(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert chunks > 1 and peak < 80 << 20


def test_parts_grow_with_the_text_only():
    """Every chunk sends a row to every part, so parts must not grow with the tasks as well."""
    assert substring_dedup._parts(900_000_000, 51) == 153
    assert substring_dedup._parts(10_600_000_000, 600) == 600
    assert substring_dedup._parts(53_000_000_000, 3_000) < 2_000


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x0b\x0c\x1c\u00e9", max_size=60), max_size=6), st.integers(1, 8), st.integers(2, 9))
def test_words_and_windows_at_some_places(texts, k, step):
    block = _text.Block(*_text.buffers(pa.array(texts, pa.string())))
    words = block.words()
    want = [regex.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    assert [words.distinct[i] for i in words.number] == [w for own in want for w in own]
    assert np.diff(words.ptr).tolist() == [len(own) for own in want] and len(set(words.distinct)) == len(words.distinct)
    x, y, at = words.windows(k)
    some = np.arange(0, len(at), step)
    assert np.array_equal(words.hashes(k, at[some], 0), x[some]) and np.array_equal(words.hashes(k, at[some], 1), y[some])
    pieces = [tuple(own[i : i + k]) for own in want for i in range(len(own) - k + 1)]
    known = {}
    assert len(pieces) == len(at) and all(known.setdefault(p, h) == h for p, h in zip(pieces, zip(x.tolist(), y.tolist()))) and len(set(known.values())) == len(known)
