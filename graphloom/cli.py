"""Command line: python -m graphloom.cli COMMAND ...; Spark's own settings take the place of thread and buffer flags."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession

from .model import Graph
from .operators import algorithms as alg
from .operators import partition, transform
from .operators.generate import rmat
from .session import session
from .sources import FORMATS, read_graph, write_graph, write_workspace
from .sources.relations import replace_separator

TO = ["adjacency_text", "csr", "csr_bin", "edgelist_bin", "edgelist_bin_folder", "edgelist_csv", "parquet"]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, needs_input: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        if needs_input:
            c.add_argument("-i", required=True, help="file or folder")
            c.add_argument("--format", choices=FORMATS, default="edgelist_csv")
        c.add_argument("-o", help="folder; without it the first rows are shown")
        c.add_argument("--sep", default=",")
        return c

    command("pr").add_argument("--niters", type=int, default=50)
    for name in ("wcc", "coloring"):  # these run to their fixpoint; a number is a limit beyond which they fail
        command(name).add_argument("--niters", type=int)
    for name in ("sssp", "bfs"):
        command(name).add_argument("--root", type=int, default=0)
    c = command("partition")
    c.add_argument("-n", type=int, default=1)
    c.add_argument("--partitioner", choices=sorted(partition.STRATEGIES), default="edgecut")
    c.add_argument("--workspace", action="store_true", help="CSR fragments with maps, border and statistics instead of Parquet")
    command("convert").add_argument("--to", choices=TO, default="parquet")
    command("compact").add_argument("--to", choices=TO, default="parquet")
    command("show").add_argument("--count", type=int, default=20)
    command("statistics")
    command("replace-sep").add_argument("--new", default=" ")
    c = command("generate", needs_input=False)
    c.add_argument("--power", type=int, default=10)
    c.add_argument("--edges", type=int, default=1 << 14)
    for q in "abcd":
        c.add_argument(f"-{q}", type=float, default=0.25)
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--to", choices=TO, default="edgelist_csv")
    p.add_argument("--log", default="WARNING", help="level of this program's own messages")
    return p


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """The rows of a command, or None where it has written them."""
    if a.command == "generate":
        edges = rmat(spark, a.power, a.edges, a.a, a.b, a.c, a.d, a.seed)
        if not a.o:
            return edges
        write_graph(Graph(edges), a.o, a.to, a.sep)
        return None
    if a.command == "replace-sep":
        replace_separator(spark, a.i, a.o, a.sep, a.new)
        return None
    graph = read_graph(spark, a.i, a.format, a.sep)
    rounds = {"max_rounds": a.niters} if getattr(a, "niters", None) else {}
    if a.command == "convert":
        write_graph(graph, a.o, a.to, a.sep)
        return None
    edges = graph.edges
    if a.command == "compact" and a.o:
        write_graph(Graph(transform.relabel(edges, transform.compaction(edges))), a.o, a.to, a.sep)
        return None
    if a.command == "partition" and a.workspace:
        write_workspace(edges, a.o, a.partitioner, a.n)
        return None
    return {
        "wcc": lambda: alg.connected_components(graph, **rounds), "pr": lambda: alg.pagerank(graph, a.niters), "coloring": lambda: alg.coloring(graph.symmetric(), **rounds), "show": lambda: edges.limit(a.count),
        "sssp": lambda: alg.sssp(graph, a.root), "bfs": lambda: alg.bfs_reachable(graph, a.root), "partition": lambda: partition.STRATEGIES[a.partitioner](edges, a.n),
        "compact": lambda: transform.relabel(edges, transform.compaction(edges)), "statistics": lambda: transform.graph_statistics(edges),
    }[a.command]()


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    logging.basicConfig(level=a.log.upper(), format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    logging.getLogger("graphloom").info("%s", a.command)
    out = result(session(), a)
    if out is None:
        return
    if a.o and "gid" in out.columns:
        partition.write_partitioned(out, a.o)
    elif a.o:
        out.write.mode("overwrite").parquet(a.o)
    else:
        out.show()


if __name__ == "__main__":
    main()
