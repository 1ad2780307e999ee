"""Stages on null and repeated ids: one row of each group stays."""

import collections

import corpus_pipeline as cp

LONG = " ".join(f"w{i}" for i in range(60))
ALONE = "other words that stand alone"


def test_one_row_of_each_group(spark):
    rows = [(1, LONG), (1, LONG), (2, LONG), (2, ALONE), (None, LONG), (None, LONG + " x"), (None, "a text without an id"), (None, "a text without an id"), (3, LONG + " more"), (3, ALONE + " too")]
    docs = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    seen = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    exact = cp.exact(spark, docs, "")
    assert seen(exact) == collections.Counter([(1, LONG), (2, ALONE), (None, LONG + " x"), (None, "a text without an id"), (3, LONG + " more"), (3, ALONE + " too")])
    near = cp.near(spark, spark.createDataFrame(exact.collect(), docs.schema), "")
    assert seen(near) == collections.Counter([(1, LONG), (2, ALONE), (None, "a text without an id"), (3, ALONE + " too")])
    passages = spark.createDataFrame([(5, LONG, "en", "web", 1), (None, "new " + LONG, "en", "web", 1), (5, LONG + " end", "en", "web", 1)], docs.schema)
    assert seen(cp.substring(spark, passages, "")) == collections.Counter([(5, LONG), (5, "end"), (None, "new")])
