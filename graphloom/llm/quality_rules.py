"""Quality rules learned from labels as an ordered decision list.

Sequential covering: each rule is a conjunction of thresholds on statistics of a text, grown on one
part of the labelled rows and pruned on the other.  The list becomes one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._text import Block

#: Labelled rows that are fitted at most: those with the smallest hashes of the id.  The only sample taken.
FIT_ROWS = 20_000
#: Rules, conditions of a rule and thresholds tried for a statistic at most; precision that a rule needs on the rows that prune it.
MOST_RULES, MOST_CONDITIONS, CUTS, PRECISION = 12, 4, 64, 0.9

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Characters that count as shouting and as digits.
MARKS, DIGITS = "!?", "0123456789"

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_marks", "n_digits", "n_lines")

#: Quotients on which thresholds are put, by name: numerator, denominator.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "digits": ("n_digits", "word_chars"),
}


def _table(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = 1
    return out


_SYMBOL, _MARK, _DIGIT, _UPPER = _table(SYMBOLS), _table(MARKS), _table(DIGITS), _table(bytes(range(65, 91)))


def statistics(col: pa.Array) -> pa.Array:
    """A struct of STATISTICS for every whole text."""
    parts = []
    for part in _text.blocks(pa.record_batch({"t": col}), "t"):
        data, off = _text.buffers(part.column(0))
        block = Block(data, off)
        words, n = block.words(), len(off) - 1

        def summed(marked: np.ndarray, off: np.ndarray = off) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(marked)])[off])

        inside = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        size = np.concatenate([[0], np.cumsum(inside[words.end] - inside[words.start])])
        out = {"n_words": np.diff(words.ptr), "word_chars": np.diff(size[words.ptr])}
        out["n_symbols"] = summed(_SYMBOL[data])
        out["n_dup_lines"], out["n_lines"] = _lines(block, words)
        out["n_repeat_words"] = _repeats(words, 5)
        pairs = np.unique(words.doc * max(len(words.distinct), 1) + words.number)
        out["n_distinct_words"] = np.bincount(pairs // max(len(words.distinct), 1), minlength=n)
        out["n_upper"], out["n_marks"], out["n_digits"] = summed(_UPPER[data]), summed(_MARK[data]), summed(_DIGIT[data])
        parts.append(pa.StructArray.from_arrays([pa.array(out[k].astype(np.int64)) for k in STATISTICS], STATISTICS))
    kind = pa.struct([(k, pa.int64()) for k in STATISTICS])
    return pa.concat_arrays(parts).cast(kind) if parts else pa.array([], kind)


def _lines(block: Block, words: _text.Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: lines with a word that are equal to an earlier one, and lines with a word."""
    data, off, n = block.data, block.offsets, len(block.offsets) - 1
    feed = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([off[:-1], feed + 1]))
    start = start[start < len(data)]
    tile, pieces = block.tiles(start)  # a line and its feed, which a text's last line lacks
    number, lines = _text.renumbered(tile, [p.removesuffix(b"\n") for p in pieces])
    end = np.append(start[1:], len(data))
    some = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    doc = np.searchsorted(off, start[some], "right") - 1
    pairs = np.unique(doc * max(len(lines), 1) + number[some])
    all_, new = np.bincount(doc, minlength=n), np.bincount(pairs // max(len(lines), 1), minlength=n)
    return all_ - new, all_


def _repeats(words: _text.Words, k: int) -> np.ndarray:
    """Of each text: words in k-word windows that are found twice or more in it."""
    x, y, at = words.windows(k)
    doc = (np.searchsorted(words.ptr, at, "right") - 1).astype(np.uint64)
    _, own, size = _text.classes(_text.mix(x ^ _text.mix(doc)), y ^ doc)
    twice = size[own] > 1
    covered = _text.cover(at[twice], k, len(words.start))
    return np.diff(np.concatenate([[0], np.cumsum(covered)])[words.ptr])


def with_statistics(docs: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    _text.small_batches(docs.sparkSession)
    kind = "struct<" + ", ".join(f"{k}: bigint" for k in STATISTICS) + ">"
    return docs.withColumn(name, F.arrow_udf(statistics, kind)(F.col(text)))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.cut if self.above else x[self.feature] < self.cut

    def column(self, statistics: str) -> Column:
        value = _feature_column(self.feature, statistics)
        return value >= self.cut if self.above else value < self.cut


Rule = tuple[Condition, ...]


def _feature_column(name: str, statistics: str) -> Column:
    top, under = FEATURES[name]
    top = F.col(f"{statistics}.{top}").cast("double")
    return top if under is None else top / F.greatest(F.col(f"{statistics}.{under}"), F.lit(1)).cast("double")


def features(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: rows[a].astype(float) / (np.maximum(rows[b], 1) if b else 1.0) for k, (a, b) in FEATURES.items()}


def _hits(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 0) -> list[Rule]:
    """Ordered rules for rows to be dropped; what none of them covers is kept.

    Without a row of either kind the list is empty.
    """
    rng = np.random.default_rng(seed)
    left, rules = np.ones(len(bad), bool), []
    grows = rng.random(len(bad)) < 2 / 3
    while len(rules) < MOST_RULES and (left & bad & grows).any():
        on, check = left & grows, left & ~grows
        rule = _grow(x, bad, on)
        rule = _prune(rule, x, bad, check)
        hit = _hits(rule, x, len(bad)) & left if rule else np.zeros(len(bad), bool)
        seen = hit & check if (hit & check).sum() >= 5 else hit
        if not rule or not seen.any() or bad[seen].mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, on: np.ndarray) -> Rule:
    rule: list[Condition] = []
    on = on.copy()
    while len(rule) < MOST_CONDITIONS and (on & ~bad).any() and (on & bad).any():
        p0, n0 = int((on & bad).sum()), int(on.sum())
        best, gain = None, 1e-9
        for name, value in x.items():
            cuts = np.unique(np.quantile(value[on], np.linspace(0, 1, CUTS)))
            cuts = np.unique(np.concatenate([cuts, np.quantile(value[on & bad], np.linspace(0, 1, CUTS))]))
            place = np.searchsorted(cuts, value[on], "right")
            n_up = np.cumsum(np.bincount(place, minlength=len(cuts) + 1)[::-1])[::-1][1:]
            p_up = np.cumsum(np.bincount(place[bad[on]], minlength=len(cuts) + 1)[::-1])[::-1][1:]
            for above, p, n in ((True, p_up, n_up), (False, p0 - p_up, n0 - n_up)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / np.maximum(n, 1)) - np.log2(p0 / n0)), -1.0)
                i = int(np.argmax(g))
                if g[i] > gain:
                    best, gain = Condition(name, above, float(cuts[i])), g[i]
        if best is None:
            break
        rule.append(best)
        on &= best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, on: np.ndarray) -> Rule:
    """The leading part of a rule that does best on rows it was not grown on."""
    if not on.any():
        return rule

    def worth(part: Rule) -> float:
        hit = _hits(part, x, len(bad)) & on
        p = int((hit & bad).sum())
        return (2 * p - hit.sum()) / (hit.sum() + 1)

    return max((rule[:i] for i in range(len(rule), 0, -1)), key=worth, default=rule)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from the labelled texts; at most `rows` labels, those with the smallest hashes of the id, reach the driver.

    Null ids and null labels count for nothing; of labels that contradict each other the least (bad) holds, and of texts that share an
    id the one with the least statistics.  A null text has no words.  Without labels, or with labels of one kind, there are no rules.
    """
    named = labels.select(F.col(id).alias("id"), F.col(label).alias("label")).where("id is not null and label is not null")
    some = named.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id")
    seen = with_statistics(own).groupBy("id").agg(F.min("label").alias("label"), F.min("statistics").alias("s")).select("id", "label", "s.*").orderBy("id").collect()
    x = features({k: np.array([r[k] for r in seen], np.int64) for k in STATISTICS})
    return learn(x, np.array([r.label == 0 for r in seen], bool))


def verdict(rules: list[Rule], statistics: str = "statistics") -> Column:
    """The list as an ordered conditional: false by the first rule that holds, true if none does."""
    out = None
    for rule in rules:
        both = rule[0].column(statistics)
        for c in rule[1:]:
            both = both & c.column(statistics)
        out = F.when(both, False) if out is None else out.when(both, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed(statistics: str = "statistics") -> Column:
    s = {k: F.col(f"{statistics}.{k}") for k in STATISTICS}
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """docs with statistics (struct), base_failed and kept; columns of these names in docs are replaced.

    Null text has no words, so it fails the base.  Every other column passes unchanged.
    """
    out = with_statistics(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
