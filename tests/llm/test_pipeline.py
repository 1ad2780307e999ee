"""run() against plain versions of its stages."""

import collections
import math

import corpus_pipeline
from graphloom.llm import quality_rules

from . import brute


def plain_near(docs, k=5):
    sets = {doc: brute.shingles(text, k) for doc, text in docs}
    group = {doc: doc for doc in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and group[a] != group[b]:
                n = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * n >= 80 * len(sets[a] | sets[b]):
                    x, y = sorted((group[a], group[b]))
                    group = {d: x if g == y else g for d, g in group.items()}
    return {d for d, g in group.items() if d == g}


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality_rules.fit(table, spark.read.parquet(f"{sf}/labels.parquet"))
    judged = {r.doc_id: r.kept for r in quality_rules.judge(table, rules).collect()}
    docs = [(r.doc_id, r.text) for r in table.collect()]
    for doc, text in docs:
        n, _, _, _, repeats = brute.quality(text)
        if n < 10 or 100 * repeats > 20 * n:
            assert not judged[doc]
    docs = [d for d in docs if judged[d[0]]]
    kept = {r[0] for r in brute.exact(docs) if r[3]}
    docs = [d for d in docs if d[0] in kept]
    kept = plain_near(docs)
    docs = [d for d in docs if d[0] in kept]
    first, left = {}, []
    for doc, text in sorted(docs):
        w = brute.words(text)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), doc)
    for doc, text in docs:
        w, gone = brute.words(text), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < doc:
                gone |= set(range(i, i + 13))
        if not gone:
            left.append((doc, text))
        elif len(gone) < len(w):
            left.append((doc, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    want = {doc: ids for (doc, _), ids in zip(left, brute.ids([t for _, t in left], 0), strict=True)}
    by, bins = collections.defaultdict(dict), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        by[r.doc_id][r.start] = (r.length, r.ids_crc32)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(want)
    for doc, pieces in by.items():
        assert sum(n for n, _ in pieces.values()) == len(want[doc])
        assert all(crc == brute.crc(want[doc][at : at + n]) for at, (n, crc) in pieces.items())
    assert all(sum(n for _, n in b) <= 2048 for b in bins.values())
    assert len(bins) <= 1.02 * math.ceil(sum(map(len, want.values())) / 2048) + 1


def test_columns_and_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "substring dedup", "packing"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
