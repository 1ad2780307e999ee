"""The workspace of a partitioned graph: CSR fragments, id map, border, communication matrix and statistics, written and read back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import partition
from ..plans.lineage import cut
from . import binary

#: The keys of a fragment's statistics, in order.
STATISTICS = ("num_vertexes", "num_edges", "num_active_vertexes", "sum_out_border_vertexes", "sum_dlv", "sum_dgv", "sum_dlv_times_dlv", "sum_dlv_times_dgv", "sum_dgv_times_dgv")


@dataclass(frozen=True)
class Workspace:
    """Folders meta, data and vdata hold GID.bin for each fragment; statistics holds GID.yaml; message and border hold what fragments share."""

    spark: SparkSession
    folder: str

    def fragments(self) -> DataFrame:
        """gid of every fragment that has all its files; a fragment that lacks one is an error."""
        names = lambda kind: binary.get_files(self.spark, f"{self.folder}/{kind}").select(F.regexp_extract("name", r"^(\d+)\.bin$", 1).cast("int").alias("gid"))
        seen = names("meta").withColumn("kind", F.lit(1)).union(names("data").withColumn("kind", F.lit(2))).union(names("vdata").withColumn("kind", F.lit(3)))
        whole = seen.groupBy("gid").agg(F.count("*").alias("n"))
        return whole.select("gid", F.when(F.col("n") == 3, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("fragment "), F.col("gid"), F.lit(" lacks a file")))).alias("whole")).where("whole").select("gid")

    def vertices(self) -> DataFrame:
        return binary.read_csr_vertices(self.spark, self.folder)

    def edges(self, direction: str = "out") -> DataFrame:
        return binary.read_csr_edges(self.spark, self.folder, direction)

    def id_map(self) -> DataFrame:
        return binary.read_id_map(self.spark, f"{self.folder}/message/vid_map.bin")

    def border(self) -> DataFrame:
        return binary.read_bitmap(self.spark, f"{self.folder}/message/border.bin")

    def matrix(self) -> DataFrame:
        return binary.read_matrix(self.spark, f"{self.folder}/border/communication_matrix.bin")

    def statistics(self) -> DataFrame:
        """gid and the nine sums of every fragment."""
        lines = self.spark.read.text(f"{self.folder}/statistics", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("int").alias("gid"), "value")
        return lines.select("gid", *[F.regexp_extract("value", rf"(?m)^{k}: (\d+)$", 1).cast("long").alias(k) for k in STATISTICS])

    def write_values(self, values: DataFrame) -> None:
        """id, value: the fragments' vertex values anew; their structure stays."""
        binary.write_values(values, cut(self.vertices().select("id", "gid")), self.folder)


def write_workspace(edges: DataFrame, folder: str, strategy: str = "edgecut", n: int = 1, values: DataFrame | None = None) -> Workspace:
    """Partitions a graph and writes its workspace.  A fragment is one file of each kind, so n has to grow with the graph.

    By edge cut a fragment has its vertices' in- and out-edges, and border vertices are those with an edge into or from another fragment; by the
    other strategies it has its own edges, and border vertices stand in several.
    """
    spark = edges.sparkSession
    edges = cut(edges.select("src", "dst"))
    if strategy == "edgecut":
        owners = cut(partition.edge_cut(edges, n))
        binary.write_csr(edges, owners, folder, values)
        here = edges.join(owners.toDF("src", "a"), "src").join(owners.toDF("dst", "b"), "dst").where("a <> b")
        border, pairs = here.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), partition.fragment_dependencies(edges, owners)
        statistics = partition.fragment_statistics(edges, owners)
    else:
        parts = cut(partition.STRATEGIES[strategy](edges, n))
        members = cut(parts.select(F.explode(F.array("src", "dst")).alias("id"), "gid").distinct())
        _write_edge_fragments(parts, members, folder, values)
        border = partition.border_vertices(parts)
        shared = members.join(border, "id")
        pairs = shared.toDF("id", "gid_from").join(shared.toDF("id", "gid_to"), "id").where("gid_from <> gid_to").select("gid_from", "gid_to").distinct()
        owners = members.groupBy("id").agg(F.min("gid").alias("gid"))  # a vertex's statistics count once, in the first of its fragments
        statistics = partition.fragment_statistics(edges, owners)
    gids = owners.agg(F.max("gid")).first()[0]
    if gids is not None:
        binary.write_id_map(partition.vid_map(owners).select("id", F.col("local_id").alias("value")), f"{folder}/message/vid_map.bin")
    binary.write_bitmap(border, f"{folder}/message/border.bin")
    binary.write_matrix(pairs, 0 if gids is None else max(gids + 1, pairs.agg(F.coalesce(F.max(F.greatest("gid_from", "gid_to")), F.lit(-1))).first()[0] + 1), f"{folder}/border/communication_matrix.bin")
    body = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.col(k)) for k in STATISTICS])
    binary.put_files(statistics.select(F.concat(F.lit("statistics/"), F.col("gid"), F.lit(".yaml")).alias("name"), F.encode(F.concat(body, F.lit("\n")), "UTF-8").alias("file")), folder)
    return Workspace(spark, folder)


def _write_edge_fragments(parts: DataFrame, members: DataFrame, folder: str, values: DataFrame | None) -> None:
    """CSR fragments of an edge partition: each edge is an out-edge of its source and an in-edge of its target within one fragment."""
    own = members.join(values.select("id", F.col("value").cast("long").alias("value")), "id", "left") if values is not None else members.withColumn("value", F.lit(None).cast("long"))
    rows = own.select("gid", F.lit(0).alias("kind"), F.col("id").alias("a"), F.coalesce("value", F.lit(0)).cast("long").alias("b"))
    rows = rows.union(parts.select("gid", F.lit(1), "src", "dst")).union(parts.select("gid", F.lit(2), "dst", "src"))
    binary.write_fragments(rows, folder)


def relabelled(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """gid, src, dst: the edges of each fragment of an edge cut with local ids; dst is null where the target stands in another fragment."""
    ids = partition.vid_map(owners)
    a = ids.select(F.col("id").alias("src"), "gid", F.col("local_id").alias("a"))
    b = ids.select(F.col("id").alias("dst"), F.col("gid").alias("there"), F.col("local_id").alias("b"))
    return edges.join(a, "src").join(b, "dst").select("gid", F.col("a").alias("src"), F.when(F.col("gid") == F.col("there"), F.col("b")).alias("dst"))


def valid_name(name: str) -> str:
    """A table's name from a file's: what stands before the first dot, other signs replaced."""
    return re.sub(r"\W", "_", name.split("/")[-1].split(".")[0])
