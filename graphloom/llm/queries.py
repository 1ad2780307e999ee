"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, near_dedup, packing, quality_rules, sharding, substring_dedup, token_counts, token_files, url_filter
from ._store import Store

VOCABULARY = "byte_bpe_50k.json"
SHARDS, SEQUENCE, LIMIT = 40, 2048, 512
#: Host and path rules of op8.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: The block list of op8, which stands for a list from elsewhere: canonical URLs of pages whose MD5 begins with a digit of LISTED (an eighth of
#: them), and for those whose MD5 begins with a digit of ABSENT a URL that has ABSENT_PATH behind them, which hardly any page has.
LISTED, ABSENT, ABSENT_PATH = "01", "23", "/no-such-page"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law `rows`; null and empty texts have 16 bytes, and rows that repeat are rows of their own."""
    done = sharding.shard(_table(spark, sf_dir, "documents"), SHARDS, seed=1)
    text = F.col("record.text")
    return done.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Huffman-coded token files in order of doc_id, read back; a null or empty text is the end id alone, and null ids come first."""
    files = token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end=2)
    return token_files.read(files).select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents and the verdict of rules fitted to `labels`; a null or empty text has no words and fails the base."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    done = quality_rules.judge(docs, rules)
    return done.select("doc_id", *[f"statistics.{k}" for k in quality_rules.STATISTICS[:5]], "base_failed", "kept")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of 2048 tokens; a null or empty text is one piece of the end id."""
    store = Store(spark)
    items = store.written(packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end=0, size=SEQUENCE), "pieces")
    return packing.pack(items, SEQUENCE, store).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the windows of 13 words that begin in an earlier one; a null or empty text has no words, and null ids lose and take none."""
    done = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by ranked merges and decoded; a null or empty text has no ids and no bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(_table(spark, sf_dir, "documents"), path)
    named = F.array_join(F.col("ids").cast("array<string>"), " ")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(named, 256).alias("ids_sha256"), F.sha2(byte_bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents that are equal without white space; null, empty and blank texts are one group."""
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


def op8_listed(pages: DataFrame) -> DataFrame:
    """The list (canonical) that belongs to pages (url): an eighth of their URLs, and as many that hardly occur.  The empty URL isn't listed."""
    key = url_filter.canonical(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    marked = pages.select(key.alias("key"), F.substring(F.md5(key), 1, 1).alias("digit")).where("key <> ''")
    some = marked.where(F.col("digit").isin(list(LISTED))).select(F.col("key").alias("canonical"))
    return some.union(marked.where(F.col("digit").isin(list(ABSENT))).select(F.concat("key", F.lit(ABSENT_PATH))))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages by the rules and the list; a null URL, or one without ://, has neither host nor path and is allowed."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, op8_listed(pages), RULES)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by links of similarity 0.8 over four-word shingles; null, empty and blank texts are linked with nothing."""
    return near_dedup.dedup(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents; a null or empty text has none."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = token_counts.count_tokens(docs, public_tokenizers.path(VOCABULARY))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return done.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics of all documents by themselves, which SQL can express: what op3 judges before its rules."""
    done = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), [])
    return done.select("doc_id", *[f"statistics.{k}" for k in quality_rules.STATISTICS[:5]], "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (quality_base, op1_shard, op2_token_files, op3_quality_rules, op4_pack, op5_substring_dedup, op6_byte_bpe, op7_exact_dedup, op8_url_filter, op9_near_dedup, op10_token_counts)}


_WORD = r"[^\x20\x09-\x0D]+"
_HOST = "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_FITS = "(host = '{0}' or ends_with(host, '.{0}')) and starts_with(path, '/{1}')"


def _rule_case() -> str:
    rules = sorted((r for r, _ in RULES), key=len, reverse=True)
    return "case " + " ".join(f"when {_FITS.format(*r.split('/', 1))} then '{r}'" for r in rules) + " end"


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose results it can express."""
    verdict = "case " + " ".join(f"when rule = '{r}' then '{v}'" for r, v in RULES) + " when k in (select k from l) then 'block' else 'allow' end"
    any_of = lambda digits: ", ".join(f"'{d}'" for d in digits)
    return {
        "quality_base": rf"""
            with d as (select doc_id, coalesce(text, '') as t from documents),
            w as materialized (select doc_id, t, regexp_extract_all(t, '{_WORD}') as ws from d),
            g as materialized (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
            f as (select doc_id, win from g group by doc_id, win having count(*) > 1),
            p as (select doc_id, count(distinct pos) as n from (select g.doc_id, unnest(range(i, i + 5)) as pos from g join f using (doc_id, win)) group by doc_id),
            l as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '{_WORD}') group by doc_id),
            s as (select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
                coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(p.n, 0)::bigint as n_repeat_words from w left join l using (doc_id) left join p using (doc_id))
            select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from s""",
        "op5_substring_dedup": rf"""
            with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
            g as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)),
            f as (select win, min(doc_id) as first from g group by win),
            hit as (select distinct g.doc_id, unnest(range(i, i + 13)) as pos from g join f using (win) where first < g.doc_id),
            p as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from w),
            m as (select p.doc_id, p.word, p.pos, hit.pos is not null as gone from p left join hit on hit.doc_id = p.doc_id and hit.pos = p.pos),
            a as (select doc_id, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by pos) filter (not gone) as kept from m group by doc_id)
            select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join a using (doc_id)""",
        "op7_exact_dedup": r"""
            with n as (select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as k from documents),
            r as (select doc_id, k, first_value(doc_id) over (partition by k order by points desc, doc_id) as keep_id, count(*) over (partition by k) as group_size from n)
            select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(k) as text_sha256 from r""",
        "op8_url_filter": rf"""
            with h as (select page_id, {_HOST} as host, {_PATH} as path from pages),
            c as (select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') as k from h),
            m as (select k, substr(md5(k), 1, 1) as digit from c where k <> ''),
            l as (select k from m where digit in ({any_of(LISTED)}) union select k || '{ABSENT_PATH}' from m where digit in ({any_of(ABSENT)})),
            r as (select *, {_rule_case()} as rule from c)
            select page_id, host, path, rule, {verdict} as verdict from r""",
        "op9_near_dedup": rf"""
            with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as ws from documents),
            s as materialized (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1) + 1))) as i from w)),
            n as materialized (select doc_id, count(*) as n from s group by doc_id),
            i as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
            e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
            l as materialized (select a, b from e union select b, a from e),
            r(id, reached) as (select doc_id, doc_id from w union select r.id, l.b from r join l on l.a = r.reached)
            select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(reached) as component_id, w.doc_id = min(reached) as kept
            from w left join n on n.doc_id = w.doc_id join r on r.id = w.doc_id group by w.doc_id, n.n""",
    }
