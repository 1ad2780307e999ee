"""Tables of a run: no run touches another's, and none are left once it is released."""

import os

import corpus_pipeline
import pytest

from graphloom.llm import _store, byte_bpe, exact_dedup, near_dedup, packing, quality_rules, sharding, substring_dedup, token_files
from graphloom.llm._store import Store

from . import brute

DOCS = [(i, f"some words of text number {i % 7} " * (i % 4)) for i in range(40)] + [(None, None)]


@pytest.fixture
def shared(spark):
    """What has been put into the shared folder since the test began."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    return lambda: [f for f in os.listdir(folder) if f not in before and not f.endswith(".crc")]


def test_results_outlive_other_runs(spark, shared):
    store = Store(spark)
    docs = spark.createDataFrame(DOCS[:-1], "doc_id long, text string")
    mine = exact_dedup.dedup(docs, store=store)
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    corpus_pipeline.release()
    assert sorted(tuple(r) for r in mine.collect()) == sorted(brute.exact(DOCS[:-1]))
    store.release()
    assert [f for f in shared() if not f.startswith("pipeline-")] == []


def test_nothing_is_left(spark, shared):
    import public_tokenizers

    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    tables = {t.name for t in spark.catalog.listTables()}
    store = Store(spark)
    runs = [
        lambda: sharding.shard(docs, 4, store=store), lambda: token_files.read(token_files.write(docs, path, 2, store=store)), lambda: packing.pack(store.written(packing.pieces(docs, path, 0), "pieces"), store=store),
        lambda: substring_dedup.dedup(docs, store=store), lambda: byte_bpe.encode(docs, ranks, store=store), lambda: exact_dedup.dedup(docs, store=store), lambda: near_dedup.dedup(docs, store=store),
    ]
    for run in runs:
        run().count()
    assert shared()
    store.release()
    assert shared() == [] and {t.name for t in spark.catalog.listTables()} == tables


def test_without_a_catalog(spark, shared, monkeypatch):
    """Where the catalog refuses a table, chunks are joined by a shuffle and the rows are the same."""
    docs = spark.createDataFrame([d for d in DOCS if d[0] is not None], "doc_id long, text string")
    want = sorted(map(tuple, substring_dedup.dedup(docs).collect()))
    monkeypatch.setattr(_store.Store, "bucketed", lambda self, df, name, buckets, key: self.written(df, name))
    assert sorted(map(tuple, substring_dedup.dedup(docs).collect())) == want
    store = Store(spark)
    monkeypatch.undo()
    assert store.bucketed(docs, "not a name", 2, "doc_id").count() == 40  # DDL fails: a plain table
    store.release()


def test_rules_need_no_store(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert quality_rules.judge(docs, []).count() == len(DOCS)
