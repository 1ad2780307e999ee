"""Fixpoints of min and max along edges, first within what each task reads.

Each task settles its edges by themselves, a bounded number at a time, and names their components.  A component
none of whose vertices stands in another is done.  Only the others, with the values they have by then, are left to
steps between tasks: on edges that lie together as they are read, nearly none; where edges lie in no order, all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.contraction import SMALL, least_labels
from .lineage import cut

#: Edges that a task settles at a time.
TASK_EDGES = 500_000
#: Steps within a task after which a component is left to steps between tasks.
TASK_STEPS = 200
#: Largest share of vertices in several components, or not done, with which it pays to tell components apart.
MOST_SHARED = 0.25


def settled(src: np.ndarray, dst: np.ndarray, a: np.ndarray, b: np.ndarray, combine: str, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vertices of edges; their values, from a (of src) and b (of dst) on, after at most `steps` steps; the least vertex of the component of each; whether that may change yet."""
    ufunc = np.minimum if combine == "min" else np.maximum
    ids, least = least_labels(src, dst)
    x, y = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    value = np.empty(len(ids), np.int64)
    value[x], value[y] = a, b
    sends, moved = np.ones(len(x), bool), np.zeros(len(ids), bool)
    for _ in range(steps):
        before = value.copy()
        ufunc.at(value, y[sends], before[x[sends]])
        moved = value != before
        if not moved.any():
            break
        sends = moved[x]
    return ids, value, least, np.isin(least, least[moved])


def _in_task(combine: str, limit: int, steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def done() -> pa.RecordBatch:
            ids, value, least, more = settled(*(np.concatenate(c) for c in zip(*held, strict=True)), combine, steps)
            held.clear()
            mark = uuid.uuid4().int >> 65  # of this task and its edges; if two components ever had one number, both would only be taken for one that is not done
            return pa.record_batch({"id": pa.array(ids), "value": pa.array(value), "component": pa.array(least ^ mark), "more": pa.array(more)})

        for batch in batches:
            held.append([np.asarray(batch.column(i)) for i in range(4)])
            n += batch.num_rows
            if n >= limit:
                yield done()
                n = 0
        if n:
            yield done()

    return run


def settle_in_parts(edges: DataFrame, init: Column, combine: str, limit: int | None = None, steps: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """What is done (id, value); what isn't (id, value), and its edges (src, dst); or None where that is most.  edges: src, dst (longs), not null, in a table; init: a long over id."""
    best = {"min": F.min, "max": F.max}[combine]
    rows = edges.select(F.col("src").alias("id"), "dst").withColumn("a", init.cast("long"))
    rows = rows.select(F.col("id").alias("src"), F.col("dst").alias("id"), "a").withColumn("b", init.cast("long")).select("src", F.col("id").alias("dst"), "a", "b")
    rows = cut(rows.mapInArrow(_in_task(combine, limit or TASK_EDGES, steps or TASK_STEPS), "id long, value long, component long, more boolean"))
    shared = cut(rows.groupBy("id").agg(F.count("*").alias("n"), F.bool_or("more").alias("more")).where("n > 1 or more").select("id"))
    if shared.count() > MOST_SHARED * rows.count():
        return None
    small = lambda df: F.broadcast(df) if df.count() <= SMALL else df
    open_ = cut(rows.join(small(shared), "id", "left_semi").select("component").distinct())
    near = small(open_)
    rest = cut(rows.join(near, "component", "left_semi").groupBy("id").agg(best("value").alias("value")))
    left = edges.join(small(rest.select(F.col("id").alias("src"))), "src", "left_semi")
    return rows.join(near, "component", "left_anti").select("id", "value"), rest, left
