"""URL filter: host and path rules, then a blocked Bloom filter and an exact join for listed URLs.

DataFrame functions only.  A block is 512 bits, eight words of 64; a URL sets one bit in each word of
one block.  What the filter lets pass is joined with the list by the canonical URL itself, so no
false positive stays.  A filter too large to be broadcast meets the distinct URLs instead of the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._joins import left_join
from ._store import Store

#: Bits of the filter for each listed URL.
BITS = 16
#: Blocks (72 bytes each, 9 MB in all) up to which the filter is broadcast; a larger one meets the distinct URLs by its block number.
MOST_BLOCKS = 1 << 17
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The form in which URLs are listed: no scheme, query or fragment, no leading www., no / at the end."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (host/path) that fits the host or a parent domain of it and starts the path; else null."""
    fits = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        domain, _, rest = rule.partition("/")
        fits = F.when(((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest), F.lit(rule)).otherwise(fits)
    return fits


def _bits(key: Column) -> list[Column]:
    second = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(8)]


def bloom(listed: DataFrame, n: int) -> DataFrame:
    """The filter of the column `canonical` in n blocks: a row (block, w0 .. w7) for each block with a bit."""
    key = F.col("canonical")
    rows = listed.select(_block(key, n).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(_bits(key))])
    words = [F.expr(f"bit_or(shiftleft(1L, b{i}))").alias(f"w{i}") for i in range(8)]
    return rows.groupBy("block").agg(*words)


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def _passes(keyed: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """keyed (with `key`) and `possible`: whether all eight bits of the key are set."""
    set_ = F.lit(True)
    for i, b in enumerate(_bits(F.col("key"))):
        set_ = set_ & (F.expr(f"w{i}").isNotNull() & (F.call_function("getbit", F.col(f"w{i}"), b) == 1))
    met = keyed.withColumn("block", _block(F.col("key"), n)).join(words, "block", "left")
    return met.select(*keyed.columns, F.coalesce(set_, F.lit(False)).alias("possible"))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], id: str = "page_id", url: str = "url", store: Store | None = None) -> DataFrame:
    """One row per page: id, host, path, rule, verdict (the rule's, else block for a listed URL, else allow).

    listed has the column `canonical`; nulls and repeats in it count for nothing.  A null URL, or one
    without ://, has an empty host and path and fits no rule; it is allowed unless the empty URL is
    listed.  Rows that repeat are judged alike, and a URL that a third of all pages have is no hot key.  Other columns of pages, whatever
    their names, play no part.  Empty tables are allowed.
    """
    store = store or Store(pages.sparkSession)
    listed = store.written(listed.select("canonical").where("canonical is not null").distinct(), "listed")
    n = max(1, -(-listed.count() * BITS // 512))
    words = bloom(listed, n)
    p = pages.select(F.col(id).alias("id"), F.col(url).alias("url"))
    p = p.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("key", canonical(F.col("host"), F.col("path"))).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    known = listed.select(F.col("canonical").alias("key"), F.lit(True).alias("hit"))
    if n <= MOST_BLOCKS:
        p = _passes(p, F.broadcast(words), n)
        hit = left_join(p.where("possible"), known, ["key"])
        cols = ["id", "host", "path", "rule"]
        out = p.where("not possible").select(*cols, F.lit(False).alias("hit")).unionByName(hit.select(*cols, F.coalesce("hit", F.lit(False)).alias("hit")))
    else:
        possible = _passes(p.select("key").distinct(), words, n).where("possible").select("key")
        hits = store.written(possible.join(known, "key"), "hits")
        out = left_join(p, hits, ["key"]).withColumn("hit", F.coalesce("hit", F.lit(False)))
    verdict = F.when(F.col("hit"), "block").otherwise("allow")
    for rule, say in rules:
        verdict = F.when(F.col("rule") == rule, say).otherwise(verdict)
    return out.select(F.col("id").alias(id), "host", "path", "rule", verdict.alias("verdict"))
