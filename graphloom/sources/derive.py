"""Graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Where each table's ids begin in a shared id space.
OFFSETS = {"region": 0, "nation": 100, "supplier": 10_000, "part": 1_000_000, "customer": 2_000_000, "order": 10_000_000}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _edges(table: DataFrame, src: str, dst: str, a: int = 0, b: int = 0) -> DataFrame:
    return table.select((F.col(src).cast("long") + a).alias("src"), (F.col(dst).cast("long") + b).alias("dst"))


def order_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order to its customer's next one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    own = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("src"), F.lead("o_orderkey").over(w).cast("long").alias("dst"))
    return own.where("dst is not null")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers to nations, nations to regions."""
    o = OFFSETS
    a = _edges(_read(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", o["customer"], o["nation"])
    b = _edges(_read(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", o["supplier"], o["nation"])
    return a.union(b).union(_edges(_read(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey", o["nation"], o["region"]))


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to suppliers in one id space: repeats and loops."""
    return _edges(_read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


def cust_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", OFFSETS["customer"], OFFSETS["order"])


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(_read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", OFFSETS["order"], OFFSETS["part"])


def user_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's user to the next event's user, over all events in order."""
    from ..plans.indexing import dense_index

    rows = dense_index(_read(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").cast("long").alias("user")), ["ts", "event_id"], "at")
    after = rows.select((F.col("at") - 1).alias("at"), F.col("user").alias("dst"))
    return rows.join(after, "at").select(F.col("user").alias("src"), "dst")
