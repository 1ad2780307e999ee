"""Corpus pipeline: quality rules, exact dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next one's docs.  All but the last return the columns of documents.  A stage
deletes the working tables of the stage before it in the same thread, whose result has to be written by then; tables of
anything else are left alone.  Null and empty texts fail the base of the quality rules; each stage by itself takes them too.
"""

from __future__ import annotations

import threading
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, near_dedup, packing, quality_rules, substring_dedup
from graphloom.llm._store import Store
from graphloom.plans.indexing import dense_index
from graphloom.plans.lineage import delete, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_last = threading.local()


def _store(spark: SparkSession) -> Store:
    """A store for a stage; that of the stage before it is done with."""
    release()
    _last.store = Store(spark)
    return _last.store


def release() -> None:
    """Deletes the working tables of the last stage of this thread, once its result has been written."""
    if (store := getattr(_last, "store", None)) is not None:
        store.release()
        _last.store = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the learned rules reject go; null, empty and blank texts among them."""
    release()
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs.select(COLUMNS), rules).where("kept").select(COLUMNS)


def _keyed(docs: DataFrame, store: Store) -> DataFrame:
    """docs with `row`, a key of each row: the doc_id where ids are neither null nor repeated, else numbers in order of the ids, nulls last."""
    seen = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if seen.n == seen.ids:
        return docs.select(F.col("doc_id").alias("row"), *COLUMNS)
    told_apart = docs.select(F.col("doc_id").isNull().alias("unnamed"), F.monotonically_increasing_id().alias("at"), *COLUMNS)
    ordered = dense_index(told_apart, ["unnamed", "doc_id", "at"], "row", keep=lambda df: store.written(df, "numbered"))  # written before it is numbered, so `at` is the same for all readers
    return store.written(ordered.select("row", *COLUMNS), "keyed")


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of keyed docs whose verdict is kept."""
    return docs.join(verdicts.where("kept").select("row"), "row", "left_semi").select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays; null, empty and blank ones are equal."""
    store = _store(spark)
    docs = _keyed(docs, store)
    return _kept(docs, exact_dedup.dedup(docs, id="row", store=store))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one row stays; texts without words all stay."""
    store = _store(spark)
    docs = _keyed(docs, store)
    return _kept(docs, near_dedup.dedup(docs, id="row", store=store))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, of all rows but the first; a row left without words goes too, and one that loses nothing stays as it is, be it null or blank."""
    store = _store(spark)
    done = substring_dedup.dedup(_keyed(docs, store), id="row", carry=["doc_id", "lang", "source", "n_chars"], store=store)
    cut = F.col("n_removed") > 0
    done = done.where("n_removed = 0 or n_removed < n_words")
    return done.select("doc_id", F.when(cut, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of 2048 tokens; a null or empty text is the end id alone."""
    store = _store(spark)
    pieces = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0, size=2048)
    return packing.pack(store.written(pieces, "pieces"), 2048, store)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("substring dedup", substring), ("packing", pack)]

#: SQL cannot express learned rules or the packing; the tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        to = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        out.write.option("compression", "zstd").parquet(to)
        docs = spark.read.parquet(to)
        if path:
            delete(spark, path)
        path = to
    raise AssertionError("no stage")
