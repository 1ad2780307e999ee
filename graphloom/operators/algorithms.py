"""Graph algorithms: components, distances, ranks, colouring, simulation, walks."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import UNREACHED, draw
from ..model import Graph
from ..plans.indexing import dense_index
from ..plans.lineage import cut, discard
from ..plans.longpaths import settle
from ..plans.superstep import Program, run
from .contraction import star_components

#: Supersteps after which paths are contracted instead of walked: most graphs are done by then, and a path of any length takes O(log n) rounds more.
LONG_PATH = 3


def least_label_program() -> Program:
    return Program(init=F.col("id"), message=F.col("value"), combine="min", update=F.least("value", "msg"))


def min_ancestor_label(graph: Graph, max_iter: int | None = None, tolerance: float = 0.0, start: DataFrame | None = None) -> DataFrame:
    """id, label: the least id from which a vertex is reached along edges, itself included."""
    return run(graph, least_label_program(), max_iter, tolerance, start, contract_after=LONG_PATH).state.withColumnRenamed("value", "label")


def connected_components(graph: Graph, max_rounds: int = 60) -> DataFrame:
    """id, label: the least id of the weak component, by star contraction; an error if that takes more rounds."""
    if graph.vertices_ is None:  # the ends of edges: all are found but those of loops alone
        edges = cut(graph.edges.select("src", "dst"))
        found = star_components(edges, max_rounds=max_rounds).select("id", F.col("component").alias("label"))
        loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct()
        if loops.isEmpty():
            return found
        found = cut(found)
        return found.union(loops.join(found, "id", "left_anti").select("id", F.col("id").alias("label")))
    found = star_components(graph.edges, max_rounds=max_rounds).select(F.col("id").alias("own"), "component")
    return graph.vertices.join(found, F.col("id") == F.col("own"), "left").select("id", F.coalesce("component", "id").alias("label"))


def component_sizes(graph: Graph) -> DataFrame:
    return connected_components(graph).groupBy("label").agg(F.count("*").alias("size"))


def incremental_components(labels: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Labels of a grown graph from its labels so far and the new edges alone."""
    a = new_edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src", "left")
    both = a.join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst", "left")
    joined = both.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    moved = star_components(joined).select(F.col("id").alias("old"), "component")
    every = labels.select("id", "label").union(new_edges.select(F.explode(F.array("src", "dst")).alias("id")).join(labels, "id", "left_anti").distinct().select("id", F.col("id").alias("label")))
    return every.join(moved, F.col("label") == F.col("old"), "left").select("id", F.coalesce("component", "label").alias("label"))


def sssp(graph: Graph, root: int, max_iter: int | None = None, unreached: bool = False) -> DataFrame:
    """id, distance in hops along edges from the root; null, or the fixed value, where there is no path."""
    program = Program(
        init=F.when(F.col("id") == root, F.lit(0)).cast("long"), message=F.col("value") + 1, combine="min",
        update=F.least("value", "msg"), send_if=F.col("value").isNotNull(),
    )
    out = run(graph, program, max_iter).state.withColumnRenamed("value", "distance")
    return out.withColumn("distance", F.coalesce("distance", F.lit(UNREACHED).cast("long"))) if unreached else out


def bfs_reachable(graph: Graph, root: int, max_iter: int | None = None) -> DataFrame:
    """id of every vertex that the root reaches, itself included."""
    program = Program(init=F.col("id") == root, message=F.lit(True), combine="or", update=F.lit(True), send_if=F.col("value"))
    return run(graph, program, max_iter).state.where("value").select("id")


def mean_rank_program(gamma: float = 0.01, epsilon: float = 0.001) -> Program:
    moved = F.lit(gamma) * F.col("msg")
    return Program(
        init=F.lit(1.0), message=F.col("value"), combine="avg", frontier=False,
        update=F.when((F.col("value") - moved) * (F.col("value") - moved) > epsilon, F.least("value", moved)).otherwise(F.col("value")),
    )


def mean_rank(graph: Graph, max_iter: int = 10, gamma: float = 0.01, epsilon: float = 0.001) -> DataFrame:
    """id, value: from 1, the smaller of itself and gamma times the mean over in-neighbours, where that moves it enough."""
    return run(graph, mean_rank_program(gamma, epsilon), max_iter).state


def mean_rank_int(graph: Graph, max_iter: int = 10, gamma: float = 0.01, epsilon: float = 0.001) -> DataFrame:
    """The same rule on whole numbers, which drop what follows the point."""
    moved = F.lit(gamma) * F.col("msg")
    step = F.when((F.col("value") - moved) * (F.col("value") - moved) > epsilon, F.least(F.col("value"), F.floor(moved))).otherwise(F.col("value"))
    program = Program(init=F.lit(1).cast("long"), message=F.col("value"), combine="avg", frontier=False, update=step.cast("long"))
    return run(graph, program, max_iter).state


def pagerank(graph: Graph, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """id, value: textbook PageRank over V vertices from 1 / V; vertices without out-edges pass their rank on to all, so ranks add up to 1."""
    out = graph.edges.groupBy("src").agg(F.count("*").alias("out"))
    state = cut(graph.vertices.select("id").join(out, F.col("id") == F.col("src"), "left").select("id", "out"))
    n = state.count()
    edges = cut(graph.edges.select("src", "dst"))
    state = state.select("id", "out", (F.lit(1.0) / max(n, 1)).alias("value"))
    for _ in range(iterations):
        sent = state.where("out is not null").select(F.col("id").alias("src"), (F.col("value") / F.col("out")).alias("share"))
        inbox = sent.join(edges, "src").groupBy("dst").agg(F.sum("share").alias("msg"))
        told = state.join(inbox, F.col("id") == F.col("dst"), "left").select("id", "out", F.coalesce("msg", F.lit(0.0)).alias("msg"))
        lost = Observation()  # what is passed on and arrives; the rest was held by vertices without out-edges
        before, state = state, cut(told.observe(lost, F.sum("msg").alias("sum")))
        discard(before)
        spread = (1.0 - (lost.get["sum"] or 0.0)) / max(n, 1)
        state, path = state.select("id", "out", (F.lit((1 - damping) / max(n, 1) + damping * spread) + damping * F.col("msg")).alias("value")), state._path
        state._path = path
    return state.select("id", "value")


def coloring(graph: Graph, max_rounds: int | None = None) -> DataFrame:
    """id, color: from 0, a vertex goes up by one while a higher out-neighbour has its colour, all at once in each round.

    After t rounds a vertex has min(t, c), where c is one more than the largest c of its higher out-neighbours (0
    without one): as long as a vertex has gone up in every round, one that has too is level with it, and a vertex that stops is above all
    of them.  So the colours are the lengths of the longest ascending paths, and no round need be played.
    """
    if max_rounds is not None:  # played out, one round a step
        return _coloring_by_rounds(graph, max_rounds)
    up = graph.edges.where("src < dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("add"))
    return settle(graph.vertices.select("id", F.lit(0).alias("value")), up, "max").withColumnRenamed("value", "color")


def _coloring_by_rounds(graph: Graph, max_rounds: int) -> DataFrame:
    """The same rounds one by one; an error if colours still clash after the last."""
    pairs = graph.edges.where("src < dst").select("src", "dst").distinct()
    state = cut(graph.vertices.select("id", F.lit(0).cast("long").alias("color")))
    for _ in range(max_rounds):
        a, b = state.toDF("src", "a"), state.toDF("dst", "b")
        bumped = cut(pairs.join(a, "src").join(b, "dst").where("a = b").select(F.col("src").alias("id")).distinct())
        if bumped.isEmpty():
            return state
        before, state = state, cut(state.join(bumped.withColumn("up", F.lit(1)), "id", "left").select("id", (F.col("color") + F.coalesce("up", F.lit(0))).alias("color")))
        discard(before)
    if coloring_conflicts(Graph(pairs), state).first()[0]:
        raise RuntimeError(f"colours still clash after {max_rounds} rounds")
    return state


def coloring_conflicts(graph: Graph, colors: DataFrame) -> DataFrame:
    """One row: edges between different vertices of one colour."""
    a, b = colors.select(F.col("id").alias("src"), F.col("color").alias("a")), colors.select(F.col("id").alias("dst"), F.col("color").alias("b"))
    return graph.edges.where("src <> dst").join(a, "src").join(b, "dst").agg(F.count_if(F.col("a") == F.col("b")).alias("conflicts"))


def simulation(graph: Graph, labels: DataFrame, pattern: list[tuple[str, str]], max_iter: int | None = None) -> DataFrame:
    """id, label: the greatest relation in which each matched vertex has, for every pattern edge of its label, a matched out-neighbour.

    labels: id, label.  pattern: (label, label) edges.
    """
    state = cut(labels.where(F.col("label").isin(sorted({x for e in pattern for x in e}))).select("id", "label"))
    for _ in itertools.count() if max_iter is None else range(max_iter):
        kept = state
        for left, right in pattern:
            near = graph.edges.join(state.where(F.col("label") == right).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
            good = kept.where(F.col("label") == left).join(near, "id", "left_semi")
            kept = kept.where(F.col("label") != left).unionByName(good)
        kept = cut(kept)
        if kept.count() == state.count():
            return kept
        state = kept
    raise RuntimeError(f"no fixpoint after {max_iter} rounds")


def random_walks(graph: Graph, walks: int = 5, length: int = 4, seed: int = 0) -> DataFrame:
    """src, walk, step, id: walks from every vertex along distinct edges; a walk ends at a vertex without out-edges.

    Neighbours are numbered once, and each step draws a number from the seed, the start, the walk and the step: equal seeds give equal walks, and a step costs
    a row a walk, however many edges a hub has.
    """
    numbered = dense_index(graph.edges.select("src", "dst").distinct(), ["src", "dst"], "place")
    ranges = cut(numbered.groupBy("src").agg(F.min("place").alias("first"), F.count("*").alias("degree")))
    edges = numbered.select("place", "dst")
    at = graph.vertices.select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.col("id"))
    out = at.withColumn("step", F.lit(0))
    for step in range(1, length + 1):
        place = F.col("first") + F.pmod(draw(F.lit(seed), F.col("start"), F.col("walk"), F.lit(step)), F.col("degree"))
        drawn = at.join(ranges, F.col("id") == F.col("src")).select("start", "walk", place.alias("place"))
        at = cut(drawn.join(edges, "place").select("start", "walk", F.col("dst").alias("id")))
        out = out.unionByName(at.withColumn("step", F.lit(step)))
    return out.select(F.col("start").alias("src"), "walk", "step", "id")
