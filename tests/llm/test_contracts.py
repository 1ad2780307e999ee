"""Each query against a plain version over a whole small table, and over a table of awkward rows."""

import collections
import math
import zlib

import pytest

from graphloom.llm import queries as q

from . import brute


def complements(n: int) -> tuple[str, str]:
    """Words of 2 ** n letters that are equal under any polynomial hash modulo a power of two, and differ in every letter."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


ROWS = [
    (3, ""), (1, None), (2, " \t\n"), (7, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (4, "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (5, "One  two three four"), (6, "One two three fouR\n"),
    (8, "don't 'tis <|endoftext|>stop  \n\n x<|endoftext|>"), (9, "é中文 ½ ２   　 \x1c \x85 naïve'll"), (10, "a b c d e f " * 3000), (11, "a\nb\na\n\n \n \nb\na b\na"),
    (12, "x" * 100_000), (13, "One two three fouR\n"), (14, "👍🏽 emoji" * 20), (15, "tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie"),
    (16, "tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie"),
    (20, complements(11)[0]), (21, complements(11)[1]), (22, "\n".join(complements(11))), (23, " ".join(complements(11)[i] for i in (0, 1, 1, 0, 1, 0, 0, 1) * 3)), (24, " ".join(complements(11)[i] for i in (1, 0, 0, 1, 0, 1, 1, 0) * 3)),
]


@pytest.fixture(scope="module", params=["table", "awkward", "empty"])
def data(request, spark, tmp_path_factory):
    """A directory of tables, and the rows of its documents."""
    if request.param == "table":
        sf = "/root/testdata/sf0.001"
        return sf, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sf, rows = str(tmp_path_factory.mktemp(request.param)), ROWS if request.param == "awkward" else []
    extra = "doc_id long, text string, bucket int, leaf int, key long, statistics string, kept string, n long, part int, record string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, *[None] * 11) for r in rows], extra).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(r[0], 1 - r[0] % 2, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, rows


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_op1(spark, data):
    sf, docs = data
    rows = q.op1_shard(spark, sf).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted((d, size(t), zlib.crc32((t or "").encode())) for d, t in docs)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    count = [len(slots.get(i, ())) for i in range(40)]
    assert max(count) - min(count) <= 1 and set(slots) <= set(range(40))


def test_op2(spark, data):
    sf, docs = data
    assert got(q.op2_token_files(spark, sf), "doc_id", "start", "n_tokens", "ids_crc32") == brute.token_files(docs)


def test_op3(spark, data):
    sf, docs = data
    rows = {r.doc_id: r for r in q.op3_quality_rules(spark, sf).collect()}
    assert set(rows) == {d for d, _ in docs}
    for doc, text in docs:
        n, chars, symbols, lines, repeats = brute.quality(text)
        r = rows[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), doc
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.base_failed and r.kept)


def test_op4(spark, data):
    sf, docs = data
    rows = q.op4_pack(spark, sf).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    total = 0
    for (doc, _), ids in zip(docs, brute.ids([t for _, t in docs], 0), strict=True):
        at = 0
        total += len(ids)
        for i, r in enumerate(sorted(by[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at) and (r.length == 2048 or i == 0)
            assert r.ids_crc32 == brute.crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(total / 2048) * 1.02 + 1


def test_op5(spark, data):
    sf, docs = data
    assert got(q.op5_substring_dedup(spark, sf), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring(docs))


def test_op6(spark, data):
    sf, docs = data
    assert got(q.op6_byte_bpe(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(brute.byte_bpe(docs))


def test_op7(spark, data):
    sf, docs = data
    assert got(q.op7_exact_dedup(spark, sf), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact(docs))


def test_op9(spark, data):
    sf, docs = data
    assert got(q.op9_near_dedup(spark, sf), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(docs))


@pytest.mark.parametrize("most", [2048, 1100])  # of any length; none of which two go together
def test_op4_many_leaves(spark, monkeypatch, most):
    """Several rounds up the tree keep offsets gapless, and bins that nothing can join end the rounds."""
    from graphloom.llm import packing
    from graphloom.llm._store import Store

    store = Store(spark)
    monkeypatch.setattr(packing, "LEAF", 4_000)
    monkeypatch.setattr(packing, "NODE", 300)
    length = "1 + (id * 7919) % 2048" if most == 2048 else "1030 + id % 70"
    items = store.written(spark.range(20_000).selectExpr("id", f"{length} as length"), "items")
    bins = collections.defaultdict(list)
    for r in packing.pack(items, store=store).collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(map(len, bins.values())) == 20_000
    assert len(bins) == 20_000 if most < 2048 else len(bins) <= 1.02 * sum(n for b in bins.values() for _, n in b) / 2048 + 1
    store.release()


def test_op2_is_read_by_another_session(spark, tmp_path):
    """The files hold all that it takes: codes, ids, places."""
    import public_tokenizers

    from graphloom.llm import token_files

    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    token_files.write(docs, public_tokenizers.path(q.VOCABULARY), end=2).write.parquet(f"{tmp_path}/files")
    rows = token_files.read(spark.newSession().read.parquet(f"{tmp_path}/files")).collect()
    assert sorted((r.doc_id, r.start, r.n, zlib.crc32(r.ids)) for r in rows) == brute.token_files(ROWS)
    with pytest.raises(ValueError, match="code table"):
        token_files.read(spark.read.parquet(f"{tmp_path}/files").where("part >= 0"))


def test_op10(spark, data):
    sf, docs = data
    want = [(d, len((t or "").encode()), len(x), len(x) > 512) for (d, t), x in zip(docs, brute.ids([t for _, t in docs]), strict=True)]
    assert got(q.op10_token_counts(spark, sf), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want)
