"""Fixpoints of min and max along edges, whatever the length of paths.

Vertices with two neighbours at most are taken out, an independent set of them a round: each leaves its
value with its out-neighbours and an edge from each in-neighbour to each out-neighbour, so a path of n
vertices is gone after O(log n) rounds.  What is left goes to one task once that can hold it.  Else, where all
edges lead to smaller ids, ranges of ids are settled from the top, each by one task that streams its edges; other
graphs go on in supersteps until nothing changes.  Then the vertices come back in reverse order.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph, ends
from .lineage import cut, shared_folder

#: Edges that one task settles.
TASK_EDGES = 500_000
#: Vertices, and edges between them, of a range of ids that one task settles as a stream.
RANGE_VERTICES, RANGE_EDGES = 4_000_000, 4_000_000
#: Fewest vertices that a round has to take out, as a share of those that are left.
LEAST_SHARE = 0.02


def _better(combine: str, a: Column | str, b: Column | str) -> Column:
    return F.least(a, b) if combine == "min" else F.greatest(a, b)


def settled(values: dict[int, int], edges: dict[int, list[tuple[int, int]]], combine: str) -> dict[int, int]:
    """The fixpoint, in memory.  edges: of each vertex, (dst, add).  Best first, where an edge never betters a value; else in topological order."""
    sign = 1 if combine == "min" else -1
    best = {v: sign * x for v, x in values.items()}
    if all(sign * add >= 0 for out in edges.values() for _, add in out):
        heap = [(x, v) for v, x in best.items()]
        heapq.heapify(heap)
        while heap:
            x, v = heapq.heappop(heap)
            if x > best[v]:
                continue
            for w, add in edges.get(v, ()):
                if x + sign * add < best[w]:
                    best[w] = x + sign * add
                    heapq.heappush(heap, (best[w], w))
    else:
        waiting = dict.fromkeys(best, 0)
        for out in edges.values():
            for w, _ in out:
                waiting[w] += 1
        ready, n = [v for v, k in waiting.items() if not k], 0
        while ready:
            v, n = ready.pop(), n + 1
            for w, add in edges.get(v, ()):
                best[w] = min(best[w], best[v] + sign * add)
                waiting[w] -= 1
                if not waiting[w]:
                    ready.append(w)
        if n < len(best):
            raise ValueError("no fixpoint: values grow without end around a cycle")
    return {v: sign * x for v, x in best.items()}


def _in_task(combine: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: dict[int, int] = {}
        edges: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:  # a vertex's own value has no dst
            for src, dst, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if dst is None:
                    values[src] = x
                else:
                    edges.setdefault(src, []).append((dst, x))
        done = settled(values, edges, combine)
        yield pa.record_batch({"id": pa.array(list(done), pa.int64()), "value": pa.array(list(done.values()), pa.int64())})

    return run


def _downhill(combine: str):
    """Settles a range of ids.  Rows (id, src, add) in descending order of id, of each id its own value, without src, first; src is larger and of the range."""
    best = max if combine == "max" else min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, value, n = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64), 0  # ids negated, so that they ascend
        for batch in batches:
            id, add = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            own = np.asarray(batch.column(1).is_null().to_numpy(zero_copy_only=False))
            src = np.asarray(batch.column(1).fill_null(0))[~own]
            while n + own.sum() > len(below):
                below, value = np.resize(below, 2 * len(below)), np.resize(value, 2 * len(value))
            below[n : n + own.sum()], value[n : n + own.sum()] = -id[own], add[own]
            n += int(own.sum())
            to, more = id[~own], add[~own]
            if not len(to):
                continue
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            at, place = np.searchsorted(below[:n], -src), np.searchsorted(below[:n], -to[first])
            for p, a, b in zip(place.tolist(), first.tolist(), [*first[1:].tolist(), len(to)], strict=True):
                met = value[at[a:b]] + more[a:b] if b - a > 1 else value[at[a]] + more[a]
                value[p] = best(value[p], (met.max() if combine == "max" else met.min()) if b - a > 1 else met)
        for a in range(0, n, 1 << 20):
            yield pa.record_batch({"id": pa.array(-below[a : min(n, a + (1 << 20))]), "value": pa.array(value[a : min(n, a + (1 << 20))])})

    return run


def _ranges(values: DataFrame, edges: DataFrame, n: int, vertices: int, edge_limit: int, vertex_limit: int) -> list[int]:
    """Least ids of all ranges but the first, so that a range has about vertex_limit vertices, and edge_limit edges within it, at most."""
    k = max(math.ceil(vertices / vertex_limit), math.ceil(math.sqrt(n / edge_limit)))
    bounds = sorted(set(values.agg(F.percentile_approx("id", [i / k for i in range(1, k)], 10_000)).first()[0])) if k > 1 else []
    while True:
        held = edges.groupBy(_range(F.col("src"), bounds).alias("a"), _range(F.col("dst"), bounds).alias("b")).agg(F.count("*").alias("n")).where("a = b").collect()
        large = {r.a: math.ceil(math.sqrt(r.n / edge_limit)) for r in held if r.n > 2 * edge_limit}
        if not large:
            return bounds
        k = max(large.values())
        inside = values.select("id", _range(F.col("id"), bounds).alias("a")).where(F.col("a").isin(list(large))).groupBy("a").agg(F.percentile_approx("id", [i / k for i in range(1, k)], 10_000).alias("cuts"))
        more = sorted({*bounds, *[x for r in inside.collect() for x in r.cuts]})
        if more == bounds:
            return bounds
        bounds = more


def _range(id: Column, bounds: list[int]) -> Column:
    """Number of the range that an id belongs to."""
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in bounds]).cast("array<bigint>"), lambda x: x <= id))


def _by_ranges(values: DataFrame, edges: DataFrame, n: int, combine: str, edge_limit: int | None = None, vertex_limit: int | None = None) -> DataFrame:
    """The fixpoint where every edge leads to a smaller id.  From the range of the largest ids on, each is told by those above it, in any number of tasks, and then settled by one."""
    spark, best = values.sparkSession, {"min": F.min, "max": F.max}[combine]
    bounds = _ranges(values, edges, n, values.count(), edge_limit or RANGE_EDGES, vertex_limit or RANGE_VERTICES)
    to = f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}"
    kinds = {}
    for name, rows in (("values", values.withColumn("at", _range(F.col("id"), bounds))), ("edges", edges.withColumn("at", _range(F.col("dst"), bounds)).withColumn("inner", F.col("at") == _range(F.col("src"), bounds)))):
        rows.write.partitionBy("at").parquet(f"{to}/{name}")
        kinds[name] = spark.read.schema(rows.schema).parquet(f"{to}/{name}")
    done = None
    for i in reversed(range(len(bounds) + 1)):
        own, into = kinds["values"].where(F.col("at") == i).select("id", "value"), kinds["edges"].where(F.col("at") == i)
        if done is not None:
            told = into.where("not inner").join(done.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(best(F.col("value") + F.col("add")).alias("msg"))
            own = own.join(told.withColumnRenamed("dst", "id"), "id", "left").select("id", _better(combine, "value", "msg").alias("value"))
        rows = own.select("id", F.lit(None).cast("long").alias("src"), F.col("value").alias("add")).unionByName(into.where("inner").select(F.col("dst").alias("id"), "src", "add"))
        now = cut(rows.repartition(1).sortWithinPartitions(F.desc("id"), F.asc_nulls_first("src")).mapInArrow(_downhill(combine), "id long, value long"))
        done = now if done is None else done.unionByName(now)
    return done


def _core(values: DataFrame, edges: DataFrame, n: int, combine: str, limit: int) -> DataFrame:
    if n and not edges.where("src < dst").limit(1).count():
        return _by_ranges(values, edges, n, combine)
    if n <= limit:
        tied = ends(edges)
        lone, own = values.join(tied, "id", "left_anti"), values.join(tied, "id", "left_semi")
        rows = own.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.col("value").alias("add")).unionByName(edges.select("src", "dst", "add"))
        return cut(lone.unionByName(rows.coalesce(1).mapInArrow(_in_task(combine), "id long, value long")))
    from .superstep import Program, run

    program = Program(F.col("start"), F.col("value") + F.col("add"), combine, _better(combine, "value", "msg"))
    return run(Graph(edges, values.withColumnRenamed("value", "start")), program, None).state


def settle(values: DataFrame, edges: DataFrame, combine: str, limit: int = TASK_EDGES) -> DataFrame:
    """id, value: the best (min or max) of a vertex's value and, over all paths to it, of the first vertex's value and the path's sum of `add`.

    values: id, value (longs), a row a vertex.  edges: src, dst, add (long).  Around a cycle the sum of `add` must not better a value.
    """
    best = {"min": F.min, "max": F.max}[combine]
    values = cut(values.select("id", F.col("value").cast("long").alias("value")))
    known = values.select("id")
    edges = edges.where("src <> dst").join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    edges = cut(edges.groupBy("src", "dst").agg(best(F.col("add").cast("long")).alias("add")))
    taken: list[tuple[DataFrame, DataFrame]] = []
    n, left = edges.count(), values.count()
    while n > limit:
        near = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()
        low = cut(near.groupBy("id").agg(F.count("*").alias("k"), F.min("other").alias("x"), F.max("other").alias("y")).where("k <= 2"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(taken)), c), F.col(c))
        beaten = low.select("id", F.explode(F.array_distinct(F.array("x", "y"))).alias("other")).join(low.select(F.col("id").alias("other")), "other").where(rank("other") > rank("id")).select("id")
        lone = values.join(near.select("id"), "id", "left_anti").select("id")  # without an edge its value stands
        out = cut(low.select("id").join(beaten, "id", "left_anti").union(lone))
        m = out.count()
        if m < max(1, LEAST_SHARE * left):
            break
        gone = cut(values.join(out, "id"))
        into = cut(edges.join(out.withColumnRenamed("id", "dst"), "dst").select("src", "dst", "add"))
        from_ = edges.join(out.withColumnRenamed("id", "src"), "src").select("src", "dst", "add")
        taken.append((gone, into))
        told = from_.join(gone.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(best(F.col("value") + F.col("add")).alias("msg"))
        rest = values.join(out, "id", "left_anti").join(told.withColumnRenamed("dst", "id"), "id", "left")
        over = into.select(F.col("src").alias("a"), F.col("dst").alias("v"), F.col("add").alias("first")).join(from_.select(F.col("src").alias("v"), F.col("dst").alias("b"), F.col("add").alias("second")), "v").where("a <> b")
        kept = edges.join(out.withColumnRenamed("id", "src"), "src", "left_anti").join(out.withColumnRenamed("id", "dst"), "dst", "left_anti")
        kept = kept.select("src", "dst", "add").union(over.select(F.col("a"), F.col("b"), F.col("first") + F.col("second")))
        edges = cut(kept.groupBy("src", "dst").agg(best("add").alias("add")))
        values = cut(rest.select("id", _better(combine, "value", "msg").alias("value")))
        n, left = edges.count(), left - m
    done = _core(values, edges, n, combine, limit)
    for gone, into in reversed(taken):
        told = into.join(done.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(best(F.col("value") + F.col("add")).alias("msg"))
        back = gone.join(told.withColumnRenamed("dst", "id"), "id", "left").select("id", _better(combine, "value", "msg").alias("value"))
        done = cut(done.unionByName(back))
    return done
