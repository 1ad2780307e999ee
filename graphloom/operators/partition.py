"""Partitioning of graphs into fragments, and what follows from it: borders, maps, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket_hash, range_owner
from ..model import ends
from ..plans.indexing import dense_index
from ..plans.lineage import cut


def edge_cut(edges: DataFrame, n: int) -> DataFrame:
    """id, gid: every vertex belongs to one range of ids."""
    ids = ends(edges)
    return ids.select("id", range_owner(F.col("id"), F.lit(ids.count()), n).alias("gid"))


def edge_cut_split(edges: DataFrame, n: int, new_buckets: int) -> DataFrame:
    """id, gid: the edge cut, whose fragment with most edge ends (the first of several) is dealt anew by the id modulo new_buckets; the others keep their order."""
    if new_buckets < 2:
        return edge_cut(edges, n)
    owners = cut(edge_cut(edges, n))
    ends_ = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    top = F.lit(owners.join(ends_, "id").groupBy("gid").agg(F.sum("degree").alias("sum")).agg(F.max_by("gid", F.struct("sum", -F.col("gid")))).first()[0])
    fresh = F.lit(n - 1) + F.pmod("id", F.lit(new_buckets))
    gid = F.when(F.col("gid") == top, fresh).when(F.col("gid") > top, F.col("gid") - 1).otherwise(F.col("gid"))
    return owners.select("id", gid.cast("int").alias("gid"))


def vertex_cut(edges: DataFrame, n: int) -> DataFrame:
    """src, dst, gid: every edge belongs to the bucket of its source."""
    return edges.select("src", "dst", F.pmod(bucket_hash(F.col("src")), F.lit(n)).cast("int").alias("gid"))


def grid_cut(edges: DataFrame, n: int) -> DataFrame:
    """src, dst, gid: every edge belongs to a cell of an n by n grid; cells that hold edges are numbered in order."""
    row, col = F.pmod(bucket_hash(F.col("src")), F.lit(n)), F.pmod(bucket_hash(F.col("dst")), F.lit(n))
    celled = edges.select("src", "dst", (row * n + col).alias("cell"))
    cells = celled.select("cell").distinct().select("cell", (F.dense_rank().over(Window.orderBy("cell")) - 1).cast("int").alias("gid"))  # n * n rows at most
    return celled.join(F.broadcast(cells), "cell").select("src", "dst", "gid")


def hybrid_cut(edges: DataFrame, n: int, new_buckets: int = 1) -> DataFrame:
    """src, dst, gid: the vertex cut, whose bucket with most vertices is dealt anew by the hash modulo new_buckets; the others keep their order."""
    parts = vertex_cut(edges, n)
    sizes = parts.select("gid", F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("gid").agg(F.count("*").alias("size"))
    top = F.lit(sizes.agg(F.max_by("gid", F.struct("size", -F.col("gid")))).first()[0])
    fresh = (F.lit(n - 1) + F.pmod(bucket_hash(F.col("src")), F.lit(new_buckets))).cast("int")
    gid = F.when(F.col("gid") == top, fresh).when(F.col("gid") > top, F.col("gid") - 1).otherwise(F.col("gid"))
    return parts.select("src", "dst", gid.cast("int").alias("gid"))


def border_vertices(parts: DataFrame) -> DataFrame:
    """id of every vertex that stands in more than one fragment of an edge partition."""
    held = parts.select(F.explode(F.array("src", "dst")).alias("id"), "gid").distinct()
    return held.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")


def replicas(parts: DataFrame) -> DataFrame:
    """id, gids: the fragments in which each vertex stands, in order."""
    return parts.select(F.explode(F.array("src", "dst")).alias("id"), "gid").distinct().groupBy("id").agg(F.sort_array(F.collect_set("gid")).alias("gids"))


def list_border(edges: DataFrame) -> DataFrame:
    """id of every source one of whose targets is no source."""
    sources = edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(sources, "dst", "left_anti").select(F.col("src").alias("id")).distinct()


def communication_matrix(gids: DataFrame) -> DataFrame:
    """gid_from, gid_to: all pairs of different fragments (a fragment table holds one row a fragment)."""
    own = gids.select("gid").distinct()
    row = own.agg(F.sort_array(F.collect_list("gid")).alias("all"))
    pairs = row.select(F.explode("all").alias("gid_from"), "all").select("gid_from", F.explode("all").alias("gid_to"))
    return pairs.where("gid_from <> gid_to")


def fragment_dependencies(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """gid_from, gid_to: fragments with an edge from the one into the other."""
    a, b = owners.select(F.col("id").alias("src"), F.col("gid").alias("gid_from")), owners.select(F.col("id").alias("dst"), F.col("gid").alias("gid_to"))
    return edges.join(a, "src").join(b, "dst").where("gid_from <> gid_to").select("gid_from", "gid_to").distinct()


def vid_map(owners: DataFrame) -> DataFrame:
    """id, gid, local_id: places from 0 by id within each fragment; any number of tasks share a fragment."""
    placed = dense_index(owners.select("id", "gid"), ["gid", "id"], "_place")
    first = placed.groupBy("gid").agg(F.min("_place").alias("_first"))
    return placed.join(F.broadcast(first), "gid").select("id", "gid", (F.col("_place") - F.col("_first")).alias("local_id"))  # a row a fragment


def fragment_statistics(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """One row a fragment of an edge cut, loops dropped: vertices, in- and out-edges, and sums over out-degrees within it (dl) and overall (dg)."""
    edges = edges.where("src <> dst")
    a, b = owners.select(F.col("id").alias("src"), F.col("gid").alias("here")), owners.select(F.col("id").alias("dst"), F.col("gid").alias("there"))
    out = edges.join(a, "src").join(b, "dst").groupBy("src").agg(F.count("*").alias("dg"), F.count_if(F.col("here") == F.col("there")).alias("dl"))
    into = edges.groupBy("dst").agg(F.count("*").alias("din"))
    own = owners.join(out, F.col("id") == F.col("src"), "left").join(into, F.col("id") == F.col("dst"), "left").na.fill(0, ["dg", "dl", "din"])
    total = lambda x: F.sum(x).cast("long")
    dl, dg = F.col("dl"), F.col("dg")
    return own.groupBy("gid").agg(
        F.count("*").alias("num_vertexes"), total(dg + F.col("din")).alias("num_edges"), F.count("*").alias("num_active_vertexes"), total(dg - dl).alias("sum_out_border_vertexes"),
        total(dl).alias("sum_dlv"), total(dg).alias("sum_dgv"), total(dl * dl).alias("sum_dlv_times_dlv"), total(dl * dg).alias("sum_dlv_times_dgv"), total(dg * dg).alias("sum_dgv_times_dgv"),
    )


STRATEGIES = {"edgecut": edge_cut, "vertexcut": vertex_cut, "2dvc": grid_cut, "hybridcut": hybrid_cut}


def write_partitioned(parts: DataFrame, path: str, files: int = 1) -> None:
    """One folder a fragment (gid=...), each of about `files` files by as many tasks, so that a large fragment is no large task."""
    salted = parts.repartition("gid", F.pmod(F.xxhash64(*[c for c in parts.columns if c != "gid"]), F.lit(files)))
    salted.write.partitionBy("gid").mode("overwrite").parquet(path)
