"""Degrees, statistics, adjacency, compaction, set algebra and the small table tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ends
from ..plans.indexing import dense_index, prefix_sums


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree of every vertex with an edge; one shuffle for both."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), none.alias("i"), one.alias("o")), F.struct(F.col("dst").alias("id"), one.alias("i"), none.alias("o")))).alias("x"))
    return both.groupBy("x.id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def graph_statistics(edges: DataFrame) -> DataFrame:
    """One row: largest id, largest degrees, their sums and whole averages, edges and vertices."""
    d = degrees(edges)
    return d.agg(
        F.max("id").alias("max_vid"), F.max("in_degree").alias("max_in_degree"), F.max("out_degree").alias("max_out_degree"), F.max(F.col("in_degree") + F.col("out_degree")).alias("max_degree"),
        F.sum("in_degree").alias("sum_in_degree"), F.sum("out_degree").alias("sum_out_degree"), F.expr("sum(in_degree) div count(*)").alias("avg_in_degree"), F.expr("sum(out_degree) div count(*)").alias("avg_out_degree"),
        F.sum("out_degree").alias("num_edges"), F.count("*").alias("num_vertexes"),
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, out_edges, in_edges: sorted neighbours, repeats kept."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("out_edges"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("in_edges"))
    none = F.array().cast("array<bigint>")
    both = out.join(into, "id", "full")
    both = both.select("id", F.coalesce("out_edges", none).alias("out_edges"), F.coalesce("in_edges", none).alias("in_edges"))
    return both.select("id", F.size("out_edges").cast("long").alias("out_degree"), F.size("in_edges").cast("long").alias("in_degree"), "out_edges", "in_edges")


def csr_offsets(edges: DataFrame) -> DataFrame:
    """id, out_degree, out_offset, in_degree, in_offset: where each vertex's neighbours begin in the order of ids."""
    d = prefix_sums(degrees(edges), ["id"], {"out_offset": F.col("out_degree"), "in_offset": F.col("in_degree")})
    return d.select("id", "out_degree", "out_offset", "in_degree", "in_offset")


def compaction(edges: DataFrame) -> DataFrame:
    """id, new_id: 0 to V - 1 in the order of ids."""
    return dense_index(ends(edges), ["id"], "new_id").select("id", "new_id")


def compaction_first_seen(edges: DataFrame, position: str) -> DataFrame:
    """id, new_id: 0 to V - 1 in the order in which ids appear, an edge's source before its target; `position` numbers the edges."""
    seen = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), (F.col(position) * 2).alias("at")), F.struct(F.col("dst").alias("id"), (F.col(position) * 2 + 1).alias("at")))).alias("x"))
    return dense_index(seen.groupBy("x.id").agg(F.min("x.at").alias("at")), ["at", "id"], "new_id").select("id", "new_id")


def relabel(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with every id replaced by its new_id."""
    a, b = ids.select(F.col("id").alias("src"), F.col("new_id").alias("a")), ids.select(F.col("id").alias("dst"), F.col("new_id").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def narrow(edges: DataFrame, kind: str = "int") -> DataFrame:
    """Both ids cast to another whole-number type; an id that doesn't fit is null, never another id."""
    return edges.withColumns({c: F.col(c).try_cast(kind) for c in ("src", "dst")})


# ---------------------------------------------------------------- sets of ids


def empty_ids(spark: SparkSession) -> DataFrame:
    """A set without ids."""
    return spark.range(0)


def full_ids(spark: SparkSession, n: int) -> DataFrame:
    """The set of all ids below n."""
    return spark.range(n)


def is_empty(a: DataFrame) -> DataFrame:
    """One row: whether a set has no id."""
    return a.select("id").limit(1).agg((F.count("*") == 0).alias("empty"))


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def minus_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def common_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id"), "id", "left_semi")


def same_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two sets are equal."""
    marked = a.select("id").distinct().withColumn("a", F.lit(True)).join(b.select("id").distinct().withColumn("b", F.lit(True)), "id", "full")
    return marked.agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("equal"))


def count_ids(a: DataFrame) -> DataFrame:
    return a.select("id").distinct().agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- tables


def first_columns(table: DataFrame, n: int = 2) -> DataFrame:
    return table.select(table.columns[:n])


def head_sample(table: DataFrame, ratio: float, order: list[str]) -> DataFrame:
    """The first int(rows * ratio) rows in an explicit total order; any number of tasks share them."""
    numbered = dense_index(table, order, "_place")
    return numbered.where(F.col("_place") < int(table.count() * ratio)).drop("_place")


def lookup(vertices: DataFrame, id: int) -> DataFrame:
    return vertices.where(F.col("id") == id)
