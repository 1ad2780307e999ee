"""Repeated rows, repeated and null ids: every operator returns a row (or all pieces) for each row."""

import collections

import pytest

from graphloom.llm import queries as q

from . import brute

LONG = " ".join(f"w{i}" for i in range(40))
ROWS = [(1, LONG), (1, LONG), (2, LONG), (2, "other words of the same id that stand alone here"), (None, LONG), (None, None), (3, LONG + " more"), (3, LONG + " more"), (4, ""), (4, "")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("repeats"))
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(1, 1), (1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int").write.parquet(f"{to}/labels.parquet")
    return to


@pytest.mark.parametrize("name", ["op1_shard", "op2_token_files", "op3_quality_rules", "op5_substring_dedup", "op6_byte_bpe", "op7_exact_dedup", "op9_near_dedup", "op10_token_counts"])
def test_a_row_for_a_row(spark, sf, name):
    rows = q.queries()[name](spark, sf).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d for d, _ in ROWS)


def test_classes(spark, sf):
    near = collections.Counter((r.doc_id, r.component_id, r.kept) for r in q.op9_near_dedup(spark, sf).collect())
    assert near[1, 1, True] == 2 and near[2, 1, False] == 1 and near[2, 2, True] == 1 and near[None, None, True] == 2 and near[3, 1, False] == 2 and near[4, 4, True] == 2
    exact = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in q.op7_exact_dedup(spark, sf).collect())
    assert exact[1, 1, 4, True] == 2 and exact[None, 1, 4, False] == 1 and exact[None, 4, 3, False] == 1 and exact[4, 4, 3, True] == 2
    cut = collections.Counter((r.doc_id, r.n_removed) for r in q.op5_substring_dedup(spark, sf).collect())
    assert cut[1, 0] == 2 and cut[2, 40] == 1 and cut[None, 0] == 2 and cut[3, 40] == 2


def test_pieces_and_places(spark, sf):
    total = sum(len(x) for x in brute.ids([t for _, t in ROWS], 0))
    assert sum(r.length for r in q.op4_pack(spark, sf).collect()) == total
    spans = sorted((r.start, r.n_tokens) for r in q.op2_token_files(spark, sf).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
