"""Joins whose left side may have a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key counts as heavy from this share of all rows on, so there are 1,000 heavy keys at most.
HEAVY = 1000


def left_join(rows: DataFrame, table: DataFrame, keys: list[str], held: str | None = None) -> DataFrame:
    """rows with the columns of table (a row a key at most), null where it has none.

    The rows of heavy keys stay where they are and meet the table's heavy part by broadcast, 1,000 rows at most; the others are
    shuffled by key.  `held` names a column of table with the number of rows of each key, if it has one; else they are counted.
    Null keys have no match.
    """
    total = rows.count()
    least = max(1, -(-total // HEAVY))
    named = F.expr(" and ".join(f"`{k}` is not null" for k in keys))
    if held is None:
        counts = rows.where(named).groupBy(*keys).agg(F.count("*").alias("_held")).where(F.col("_held") >= least)
        heavy = table.join(F.broadcast(counts.select(*keys)), keys, "left_semi")
    else:
        heavy = table.where(F.col(held) >= least)
    heavy = heavy.withColumn("_heavy", F.lit(True))
    rest = [c for c in table.columns if c not in keys]
    met = rows.join(F.broadcast(heavy), keys, "left")
    stays = met.where(F.col("_heavy") | ~named).drop("_heavy")
    light = met.where(F.col("_heavy").isNull() & named).drop("_heavy", *rest).join(table.hint("shuffle_merge"), keys, "left")
    return stays.unionByName(light)
