"""Global row numbers and prefix sums without a window over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column], keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """df with a column for each of `sums`: its value added up over all rows before a row in the given order.

    Rows are dealt by ranges of the order; each range adds up its own, and the driver adds one number a range and sum.  The
    order must be total.  `keep` writes the ranges.
    """
    values = {f"_value{i}": v.cast("long") for i, v in enumerate(sums.values())}
    ranged = keep(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumns(values))
    base, done = [], [0] * len(values)
    for r in ranged.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values]).orderBy("_range").collect():
        base.append((r["_range"], list(done)))
        done = [d + (r[v] or 0) for d, v in zip(done, values, strict=True)]
    within = Window.partitionBy("_range").orderBy(*order)
    out = {}
    for i, (name, v) in enumerate(zip(sums, values, strict=True)):
        offsets = F.create_map(*[F.lit(x) for range_, d in base for x in (range_, d[i])]) if base else F.create_map(F.lit(-1), F.lit(0))
        out[name] = (F.element_at(offsets, F.col("_range")) + F.sum(v).over(within) - F.col(v)).cast("long")
    return ranged.withColumns(out).drop("_range", *values)


def prefix_sum(df: DataFrame, order: list[str], value: Column, name: str, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """The same for one sum."""
    return prefix_sums(df, order, {name: value}, keep)


def dense_index(df: DataFrame, order: list[str], name: str, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """df with the number, from 0, of each row in the given total order."""
    return prefix_sum(df, order, F.lit(1), name, keep)
