"""Token counts by a two-tier lookup on the map side; no pre-token is shuffled.

First tier: a compact table of the lengths of frequent pre-tokens, at most FREQUENT of them, broadcast.  Second tier: the worker's own bounded
cache, which the library fills for pre-tokens that it meets first.  Either finds a pre-token by its bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._text import Block
from ._tokens import encoder

#: Pre-tokens of the broadcast table, and bytes of the longest: 80 bytes each at most, so 5 MB however large the corpus is.
FREQUENT, LONGEST = 65_536, 64
#: Rows that choose the first tier, about, drawn alike from all of them.  A bounded sample: what the table lacks the second tier
#: encodes, so no count depends on it.
CHOOSING_ROWS = 4_096


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pre-tokens that a task's drawn rows have more than once, end to end, with their lengths and how often each occurs: one row a task that has any."""
    total: Counter[bytes] = Counter()
    for batch in batches:
        for part in _text.blocks(batch, "text"):
            block = Block(*_text.buffers(part.column(0)))
            number, words = block.tiles(_text.pretokens(block)[0])
            for word, n in zip(words, np.bincount(number, minlength=len(words)).tolist(), strict=True):
                if len(word) <= LONGEST:
                    total[word] += n
    some = [(w, n) for w, n in total.most_common(FREQUENT) if n > 1]
    sizes, often = (np.array(x, "<u4").tobytes() for x in ([len(w) for w, _ in some], [n for _, n in some]))
    if some:
        yield pa.record_batch({c: pa.array([x], pa.binary()) for c, x in (("words", b"".join(w for w, _ in some)), ("sizes", sizes), ("counts", often))})


def frequent(docs: DataFrame, path: str, text: str = "text") -> dict[bytes, int]:
    """The first tier: frequent pre-tokens and their lengths in tokens."""
    n = docs.count()
    drawn = docs.select(F.col(text).alias("text")).sample(min(1.0, CHOOSING_ROWS / max(n, 1)), 1)
    total: Counter[bytes] = Counter()
    for r in drawn.mapInArrow(_counted, "words binary, sizes binary, counts binary").collect():  # of about CHOOSING_ROWS texts, however many there are
        ends = np.cumsum(np.frombuffer(r.sizes, "<u4")).tolist()
        for a, b, n in zip([0, *ends[:-1]], ends, np.frombuffer(r.counts, "<u4").tolist(), strict=False):
            total[bytes(r.words[a:b])] += n
    words = [w for w, _ in total.most_common(FREQUENT)]
    return dict(zip(words, encoder(path).sizes(words).tolist(), strict=True)) if encoder(path).split else {}


def count_tokens(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs with the column `name`: tokens of the whole text as the library gives them.

    Null and empty texts have 0 tokens.  A special token's name inside a text is one token.  Rows that repeat count alike, and a very long
    text is counted whole.  All other columns pass unchanged; a column called `name` is replaced.  An empty table stays empty.
    """
    _text.small_batches(docs.sparkSession)
    tier = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text))

    def counts(col: pa.Array) -> pa.Array:
        enc, table = encoder(path), tier.value
        out = [np.zeros(0, np.int64)]
        for part in _text.blocks(pa.record_batch({"t": col}), "t"):
            own = part.column(0)
            data, off = _text.buffers(own)
            raw = data.tobytes() if enc.special else b""
            if not enc.split or any(s.encode() in raw for s in enc.special):
                out.append(enc.counts(own))
                continue
            block = Block(data, off)
            start, _ = _text.pretokens(block)
            number, words = block.tiles(start)
            size = np.fromiter((table.get(w, -1) for w in words), np.int64, len(words))
            miss = np.flatnonzero(size < 0)
            size[miss] = enc.sizes([words[i] for i in miss.tolist()])
            done = np.concatenate([[0], np.cumsum(size[number] if len(words) else size)])
            out.append(np.diff(done[block.owners(start)]))
        return pa.array(np.concatenate(out), pa.int64())

    return docs.withColumn(name, F.arrow_udf(counts, "long")(F.col(text)))
