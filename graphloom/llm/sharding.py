"""Two-pass external shuffle into shards.

Pass one scatters the rows by a seeded hash over buckets that fit in memory; pass two deals each
bucket by a seeded Fisher-Yates shuffle.  The buckets end to end are one permutation of all rows,
which is cut into shards whose counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.indexing import prefix_sum
from . import _text
from ._store import Store

#: Bytes that a bucket is meant to hold.
BUCKET_BYTES = 32 << 20


def _is_scan(df: DataFrame) -> bool:
    """Whether a frame only reads files, row by row: then it gives the same rows in the same places each time."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return plan.nodeName().startswith("LogicalRelation") or plan.nodeName().startswith("Relation")


def _bytes(df: DataFrame) -> Column:
    """Bytes of a row: those of texts and binary values, and 16 for any other column."""
    sizes = [F.coalesce(F.octet_length(df[f"`{f.name}`"]), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(16) for f in df.schema.fields]
    return sum(sizes, F.lit(16)).cast("long")


def shard(docs: DataFrame, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, store: Store | None = None) -> DataFrame:
    """Writes all rows to shard folders of the shared store; returns them: shard, slot, record.

    `record` is the whole row, so that no column's name can clash.  The bucket and the place of a row follow from its place in docs and the
    seed alone, whatever it holds, so rows that repeat spread like any others, and a task that runs again on the same files
    writes the same.  What is more than a scan of files is written first.  Null values make no difference.  An empty table gives an empty one.
    """
    spark, store = docs.sparkSession, store or Store(docs.sparkSession)
    _text.small_batches(spark)
    if len(set(docs.columns)) < len(docs.columns):  # names that repeat: numbered, then given back
        names, docs = docs.columns, docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    else:
        names = docs.columns
    docs = docs if _is_scan(docs) else store.written(docs, "rows")
    kind = "struct<" + ", ".join(f"`{n}`: {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True)) + ">"
    record = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).cast(kind)
    rows = docs.select(record.alias("record"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("key"), _bytes(docs).alias("size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    bucket = F.pmod("key", F.lit(n)).alias("bucket")
    counts = prefix_sum(rows.select(bucket).groupBy("bucket").agg(F.count("*").alias("held")), ["bucket"], F.col("held"), "base", keep=lambda df: store.written(df, "counts"))
    all_rows = counts.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]

    def deal(k: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = pc.sort_indices(table.column("key")).to_numpy(zero_copy_only=False).copy()
        np.random.default_rng([seed, k[0].as_py()]).shuffle(order)  # Fisher-Yates
        place = table.column("base")[0].as_py() + np.arange(len(order))
        to = place * shards // max(all_rows, 1)
        slot = place - -(-to * all_rows // shards)
        return pa.table({"shard": pa.array(to, pa.int32()), "slot": pa.array(slot, pa.int64()), "record": table.column("record").take(pa.array(order))})

    schema = f"shard int, slot long, record {kind}"
    keyed = rows.select("record", "key", bucket).join(counts.select("bucket", "base").hint("merge"), "bucket")
    dealt = keyed.groupBy("bucket").applyInArrow(lambda k, t: deal(k, t), schema)
    path = store.place("shards")
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)
