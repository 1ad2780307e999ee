"""Connected components by contraction: bounded tasks first contract what they hold, then stars (published as large-star, small-star) bring the rest together.

Rounds grow with the logarithm of a component's size rather than with its diameter.  A star step is a
grouped minimum and a join, so a vertex of any degree is never gathered in one row; a contracting task
holds TASK_EDGES edges at most, however many there are in all.  Vertices tied to one other vertex alone are laid aside before
a star step and follow that vertex in the end, so a round moves only what is not yet whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, discard

#: Edges that one contracting task holds at a time.
TASK_EDGES = 500_000
#: Rows of a table that is sent to all tasks.
SMALL = 500_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of edges and the least end of the component of each."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        p, q = root[x], root[y]
        if (p == q).all():
            return ids, ids[root]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _contracted(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def forest() -> pa.RecordBatch:
            id, least = least_labels(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
            held.clear()
            on = id != least
            return pa.record_batch({"hi": pa.array(id[on], pa.int64()), "lo": pa.array(least[on], pa.int64())})

        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            size += batch.num_rows
            if size >= limit:
                yield forest()
                size = 0
        if size:
            yield forest()

    return run


def contract(edges: DataFrame, n: int, limit: int = TASK_EDGES) -> tuple[DataFrame, bool]:
    """Each task's edges as stars around their least ends; and whether one task held them all."""
    tasks = max(1, -(-n // limit))
    return edges.coalesce(tasks).mapInArrow(_contracted(2 * limit), "hi long, lo long"), tasks == 1


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a vertex is tied to the least of the vertex and its neighbours."""
    both = edges.select("hi", "lo").union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("least").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the least of these."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    tied = edges.join(least, "hi").where("lo > least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return tied.union(least.select("hi", F.col("least").alias("lo"))).distinct()


def _without_leaves(forest: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, int]:
    """The edges whose upper end has no other edge; the rest, and how many vertices still stand in the way there: upper ends with several edges, or lower ones too."""
    one = F.explode(F.array(F.struct(F.col("hi").alias("id"), F.lit(1).alias("up")), F.struct(F.col("lo").alias("id"), F.lit(0).alias("up")))).alias("x")
    busy = keep(forest.select(one).groupBy("x.id").agg(F.sum("x.up").alias("up"), F.count("*").alias("n")).where("up >= 1 and n >= 2").select(F.col("id").alias("hi")))
    n = busy.count()
    if n <= SMALL:
        return forest.join(F.broadcast(busy), "hi", "left_anti"), forest.join(F.broadcast(busy), "hi", "left_semi"), n
    marked = keep(forest.join(busy.withColumn("busy", F.lit(True)), "hi", "left"))
    return marked.where("busy is null").drop("busy"), marked.where("busy").drop("busy"), n


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, keep: Callable[[DataFrame], DataFrame] = cut, limit: int = TASK_EDGES) -> DataFrame:
    """id, component (least id of the component) of every end of an edge that is no loop; loops and nulls are passed over."""
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    edges = keep(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")))
    aside: list[tuple[DataFrame, bool]] = []
    for _ in range(max_rounds):
        forest, done = contract(edges, edges.count(), limit)
        forest = keep(forest)
        discard(edges)
        edges = forest
        if done:
            break
        leaves, rest, n = _without_leaves(forest, keep)
        aside.append((leaves, n <= SMALL))
        if not n:
            edges = None
            break
        edges = keep(_small_star(_large_star(rest)))
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    found = None if edges is None else _starred(edges)
    for i, (leaves, small) in reversed(list(enumerate(aside))):
        own = _starred(leaves)
        if found is None:
            found = own
            continue
        small = small and found.count() <= SMALL
        told = own.join((F.broadcast(found) if small else found).toDF("component", "least"), "component", "left")
        told = told.where("id <> component or least is null").select("id", F.coalesce("least", "component").alias("component"))  # a lower end that is known already is known once
        found = found.union(told) if i == 0 else keep(found.union(told))
    return found


def _starred(stars: DataFrame) -> DataFrame:
    """id, component of both ends of edges to the least of a component."""
    return stars.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(stars.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
