"""Each stage on awkward rows: null and blank texts, very long ones, ties, repeated and null ids, other columns, no rows."""

import collections

import corpus_pipeline as cp
import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
GOOD = "a clean text of several different words which no other document of this small table repeats at all"
ROWS = [(1, GOOD), (2, GOOD), (2, "another clean text with words of its own that stands under an id used twice over"), (None, GOOD + " x"), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, LONG), (7, LONG + " more"), (8, "word " * 40)]
KIND = "doc_id long, text string, lang string, source string, n_chars long, row long, kept boolean, statistics string, held long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "web", len(t or ""), 0, False, "x", 1) for d, t in ROWS], KIND)


def texts(df):
    return collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("i", range(4))
def test_columns(spark, docs, i):
    out = cp.STAGES[i][1](spark, docs, "/root/testdata/sf0.001")
    assert out.columns == cp.COLUMNS and set(texts(out)) - set(texts(docs)) == set() or i == 3


def test_quality(spark, docs):
    seen = texts(cp.quality(spark, docs, "/root/testdata/sf0.001"))
    assert (1, GOOD) in seen and (6, LONG) in seen
    assert not any(t is None or not t.split() for _, t in seen) and (8, "word " * 40) not in seen


def test_exact(spark, docs):
    seen = texts(cp.exact(spark, docs, ""))
    assert sum(n for (_, t), n in seen.items() if t == GOOD) == 1 and sum(n for (_, t), n in seen.items() if not (t or "").split()) == 1
    assert seen[6, LONG] == 1 and seen[7, LONG + " more"] == 1


def test_near(spark, docs):
    seen = texts(cp.near(spark, docs, ""))
    assert sum(n for (_, t), n in seen.items() if (t or "").startswith(GOOD)) == 1
    assert seen[6, LONG] == 1 and seen[7, LONG + " more"] == 0 and sum(n for (_, t), n in seen.items() if not (t or "").split()) == 4


def test_substring(spark, docs):
    seen = texts(cp.substring(spark, docs, ""))
    assert seen[1, GOOD] == 1 and seen[2, GOOD] == 0 and seen[6, LONG] == 1 and seen[7, "more"] == 1 and seen[3, None] == 1


def test_packing(spark, docs):
    rows = cp.pack(spark, docs, "").collect()
    assert collections.Counter(r.doc_id for r in rows if r.start == 0) == collections.Counter(d for d, _ in ROWS)
    fill = collections.Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
