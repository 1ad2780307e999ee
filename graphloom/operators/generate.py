"""Recursive-matrix graphs from seeded hashes: equal seeds give equal graphs on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import PRIME, draw


def rmat(spark: SparkSession, power: int, edges: int, a: float = 0.25, b: float = 0.25, c: float = 0.25, d: float = 0.25, seed: int = 0, distinct: bool = True) -> DataFrame:
    """src, dst over 2 ** power ids: each bit of an edge picks a quadrant with chances a, b, c, d; repeats collapse."""
    if abs(a + b + c + d - 1) > 1e-9:
        raise ValueError("the chances must add up to 1")

    one, two, three = (int(x * PRIME) for x in (a, a + b, a + b + c))
    out = spark.range(edges).select("id", F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"))
    out = out.select("src", "dst", *[draw(F.lit(seed), F.lit(i), F.col("id")).alias(f"u{i}") for i in range(power)])
    bits = [(F.col(f"u{i}") >= two, ((F.col(f"u{i}") >= one) & (F.col(f"u{i}") < two)) | (F.col(f"u{i}") >= three)) for i in range(power)]
    for at, name in ((0, "src"), (1, "dst")):
        out = out.withColumn(name, sum((F.when(bit[at], 1 << (power - 1 - i)).otherwise(0).cast("long") for i, bit in enumerate(bits)), F.lit(0).cast("long")))
    out = out.select("src", "dst")
    return out.distinct() if distinct else out
