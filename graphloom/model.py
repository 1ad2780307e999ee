"""Property graphs as pairs of DataFrames; vertices are the ends of edges unless given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ends(edges: DataFrame) -> DataFrame:
    """id of every vertex that has an edge, once."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _once(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.groupBy("src", "dst").agg(*[F.min(c).alias(c) for c in rest]) if rest else edges.select("src", "dst").distinct()


@dataclass(frozen=True)
class Graph:
    """edges: src, dst (long) and perhaps weight; vertices: id and any properties."""

    edges: DataFrame
    vertices_: DataFrame | None = None

    @property
    def vertices(self) -> DataFrame:
        return ends(self.edges) if self.vertices_ is None else self.vertices_

    def without_loops(self) -> Graph:
        return Graph(self.edges.where("src <> dst"), self.vertices_)

    def deduplicated(self) -> Graph:
        """Each pair once, with the least of its weights (and of any other column)."""
        return Graph(_once(self.edges), self.vertices_)

    def reversed(self) -> Graph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), self.vertices_)

    def both_ways(self) -> Graph:
        """Both directions of every edge, next to each other; repeats stay."""
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        ways = F.explode(F.array(F.struct("src", "dst", *rest), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)))
        return Graph(self.edges.select(ways.alias("e")).select("e.*"), self.vertices_)

    def symmetric(self) -> Graph:
        """Both directions of every edge, each once, with the least weight of either."""
        return Graph(_once(self.edges.unionByName(self.reversed().edges)), self.vertices_)

    def __or__(self, other: Graph) -> Graph:
        return Graph(self.edges.unionByName(other.edges, allowMissingColumns=True))
