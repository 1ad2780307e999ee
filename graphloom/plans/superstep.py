"""Vertex programs: supersteps of joins and grouped messages until nothing changes.

A program is four Columns.  The driver holds only counts; state goes through the shared folder once a
step, so that the plan stays short and lost executors cost one step at most.
"""

from __future__ import annotations

import dataclasses
import functools
import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import combiners
from ..model import Graph
from .inparts import settle_in_parts
from .lineage import cut, discard
from .longpaths import settle

_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Program:
    """init over the vertex's columns; message over src, dst, value (of src) and the edge's columns; update over id, value and msg.

    With `frontier` only vertices that changed in the last step send, which suits min, max and `or`;
    without it every vertex sends in every step.  `aggregate` folds the final state to one row.
    """

    init: Column
    message: Column
    combine: str
    update: Column
    frontier: bool = True
    send_if: Column | None = None
    aggregate: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Result:
    state: DataFrame
    steps: int
    metrics: list[dict] = field(default_factory=list)

    def metrics_frame(self) -> DataFrame:
        """A row a step: step, active, changed, elapsed_time (seconds), and the sums of COUNTERS if the run was given owners."""
        kind = "step int, active long, changed long, elapsed_time double"
        if self.metrics and COUNTERS[0] in self.metrics[0]:
            kind += ", inc_type int, " + ", ".join(f"{c} long" for c in COUNTERS)
        return self.state.sparkSession.createDataFrame(self.metrics or [], kind)


#: Sums over the active vertices of a step: out-edges within the fragment (dl) and overall (dg), their products, edges from and to other fragments, all edges,
#: vertices of the graph.
COUNTERS = ("sum_dlv", "sum_dgv", "sum_dlv_times_dlv", "sum_dlv_times_dgv", "sum_dgv_times_dgv", "sum_in_border_vertexes", "sum_out_border_vertexes", "num_edges", "num_vertexes")


def _degrees(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """id, dl, dg, il, ig: out- and in-edges of each vertex within its fragment and overall, loops left out."""
    a, b = owners.select(F.col("id").alias("src"), F.col("gid").alias("here")), owners.select(F.col("id").alias("dst"), F.col("gid").alias("there"))
    placed = edges.where("src <> dst").join(a, "src").join(b, "dst").select("src", "dst", (F.col("here") == F.col("there")).cast("long").alias("own"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    side = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("own").alias("dl"), one.alias("dg"), none.alias("il"), none.alias("ig")), F.struct(F.col("dst").alias("id"), none.alias("dl"), none.alias("dg"), F.col("own").alias("il"), one.alias("ig")))).alias("x")
    return placed.select(side).groupBy("x.id").agg(*[F.sum(f"x.{c}").alias(c) for c in ("dl", "dg", "il", "ig")])


def _counters(active: DataFrame, known: DataFrame, vertices: int) -> dict[str, int]:
    dl, dg = F.col("dl"), F.col("dg")
    sums = dict(zip(COUNTERS, (dl, dg, dl * dl, dl * dg, dg * dg, F.col("ig") - F.col("il"), dg - dl, dg + F.col("ig")), strict=False))
    return {k: v or 0 for k, v in active.join(known, "id").agg(*[F.sum(v).alias(k) for k, v in sums.items()]).first().asDict().items()} | {"num_vertexes": vertices}


def run(graph: Graph, program: Program, max_iter: int | None = 50, tolerance: float = 0.0, start: DataFrame | None = None, every_step: Callable[[int, DataFrame], None] | None = None, contract_after: int | None = None, owners: DataFrame | None = None) -> Result:
    """State (id, value, changed) after the program's fixpoint; a program without `frontier` may end after max_iter steps.

    The run halts once at most tolerance * vertices changed; a program with `frontier` that still changes after max_iter
    steps is an error (None: no limit).  `start` (id, value, and perhaps changed) warms it
    up: vertices that it lacks, and those it marks, are active at the outset.  `contract_after` is for programs whose
    message is the value, a long, and whose update is the min or max of value and message: if vertices still change after
    that many steps, paths are contracted instead of walked; what is done then is no step and not in the metrics.  Such a program without a limit
or a start first settles what each task reads (inparts.py), and steps go over what is left alone.  With `owners` (id, gid) the metrics count what COUNTERS names, at the price of a job a step.
    """
    if contract_after is not None and program.combine not in ("min", "max"):
        raise ValueError("only min and max are contracted")
    spark = graph.edges.sparkSession
    whole = contract_after is not None and max_iter is None and tolerance == 0 and start is None and every_step is None and owners is None
    if whole and graph.vertices_ is None and dict(graph.edges.dtypes).items() >= {("src", "bigint"), ("dst", "bigint")}:
        graph = Graph(cut(graph.edges.select("src", "dst")))
        if graph.edges.where("src is null or dst is null").isEmpty() and (parted := settle_in_parts(graph.edges, program.init, program.combine)) is not None:
            done, rest, left = parted
            out = Result(done, 0)
            if not rest.isEmpty():
                own = dataclasses.replace(program, init=F.col("start"), aggregate=None)
                out = run(Graph(left, rest.withColumnRenamed("value", "start")), own, None, contract_after=contract_after)
                out.state = done.unionByName(out.state)
            return dataclasses.replace(out, state=program.aggregate(out.state)) if program.aggregate else out
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = graph.edges.repartition(parts, "src").persist()
    state = graph.vertices.withColumn("value", program.init).withColumn("changed", F.lit(True))
    if start is not None:
        marked = F.col("changed") if "changed" in start.columns else F.lit(False)
        old = start.select("id", F.col("value").alias("old"), marked.alias("marked"))
        state = state.join(old, "id", "left").withColumn("changed", F.col("old").isNull() | F.col("marked")).withColumn("value", F.coalesce("old", "value")).drop("old", "marked")
        state = state.withColumn("changed", F.lit(True)) if not program.frontier else state
    state = cut(state.select("id", "value", "changed"))
    total, metrics, step = state.count(), [], 0
    known = cut(_degrees(graph.edges, owners)) if owners is not None else None
    active = state.where("changed").count() if start is not None else total
    held = _Changes(state, total, keep=every_step is not None) if program.frontier else _Whole(state, keep=every_step is not None)
    while active > 0 and (max_iter is None or step < max_iter) and (contract_after is None or step < contract_after):
        step += 1
        began = time.perf_counter()
        front = held.front()
        counted = {"inc_type": int(step > 1)} | _counters(front, known, total) if known is not None else {}
        sent = front.select(F.col("id").alias("src"), "value").join(edges, "src")
        sent = sent if program.send_if is None else sent.where(program.send_if)
        changed = held.take(sent.select(F.col("dst").alias("id"), program.message.alias("msg")).groupBy("id").agg(combiners[program.combine]("msg").alias("msg")), program.update)
        metrics.append({"step": step, "active": active, "changed": changed, "elapsed_time": time.perf_counter() - began} | counted)
        _log.info("step %d: %d active, %d changed, %.3f s", step, active, changed, metrics[-1]["elapsed_time"])
        if every_step:
            every_step(step, held.marked())
        active = changed
        if changed <= tolerance * total:
            break
    state = held.whole()
    if active > tolerance * total and step == contract_after:
        state, active = settle(state, edges.select("src", "dst", F.lit(0).cast("long").alias("add")), program.combine), 0
    edges.unpersist()
    if program.frontier and active > tolerance * total:
        raise RuntimeError(f"no fixpoint after {max_iter} steps: {active} vertices still change")
    done = state.select("id", "value")
    return Result(program.aggregate(done) if program.aggregate else done, step, metrics)


def _told(update: Column) -> Column:
    """A vertex's value after its messages, if it had any."""
    return F.when(F.col("msg").isNull(), F.col("value")).otherwise(update)


class _Whole:
    """State whose every vertex sends: all rows are written anew in each step."""

    def __init__(self, state: DataFrame, keep: bool):
        self.state, self.keep = state, keep

    def front(self) -> DataFrame:
        return self.state

    def marked(self) -> DataFrame:
        return self.state

    def whole(self) -> DataFrame:
        return self.state

    def take(self, inbox: DataFrame, update: Column) -> int:
        """Takes the messages (id, msg); returns how many values changed."""
        told = self.state.join(inbox, "id", "left").select("id", _told(update).alias("new"), F.col("value").alias("old"))
        seen = Observation()  # counted while the state is written, without a job of its own
        told = told.select("id", F.col("new").alias("value"), (~F.col("new").eqNullSafe(F.col("old"))).alias("changed"))
        before, self.state = self.state, cut(told.observe(seen, F.count_if("changed").alias("changed")))
        if not self.keep:  # a caller that sees every step may hold the state
            discard(before)
        return seen.get["changed"]


class _Changes:
    """State of a program with a frontier: a base, and the rows that changed since, a table a step.

    A step reads the base's values of vertices with messages only, and writes what changed.  Once the tables are MOST, or
    hold a SHARE-th of all vertices, they go into a new base.
    """

    MOST, SHARE = 8, 4

    def __init__(self, state: DataFrame, total: int, keep: bool):
        self.base, self.moved, self.total, self.keep = state, state.where("changed").select("id", "value"), total, keep
        self.recent: list[DataFrame] = []
        self.rows = 0

    def front(self) -> DataFrame:
        return self.moved

    def marked(self) -> DataFrame:
        moved = self.moved.select("id", F.lit(True).alias("changed"))
        return self.whole().join(moved, "id", "left").select("id", "value", F.coalesce("changed", F.lit(False)).alias("changed"))

    def whole(self) -> DataFrame:
        return self._now(self.base.select("id", "value"))

    def _now(self, rows: DataFrame) -> DataFrame:
        """rows (with id and value) with the values of the last step."""
        if not self.recent:
            return rows
        told = functools.reduce(DataFrame.unionByName, [t.select("id", F.struct("value").alias("now"), F.lit(i).alias("at")) for i, t in enumerate(self.recent)])
        rest = [c for c in rows.columns if c != "value"]
        met = rows.join(told.groupBy("id").agg(F.max_by("now", "at").alias("now")), "id", "left")
        return met.select(*rest, F.when(F.col("now").isNotNull(), F.col("now.value")).otherwise(F.col("value")).alias("value"))

    def take(self, inbox: DataFrame, update: Column) -> int:
        """Takes the messages (id, msg); returns how many values changed."""
        met = self._now(self.base.select("id", "value").join(inbox, "id"))
        told = met.select("id", _told(update).alias("new"), F.col("value").alias("old")).where(~F.col("new").eqNullSafe(F.col("old")))
        seen = Observation()
        before, self.moved = self.moved, cut(told.select("id", F.col("new").alias("value")).observe(seen, F.count("*").alias("n")))
        if not self.keep and before not in self.recent:
            discard(before)
        n = seen.get["n"]
        self.recent.append(self.moved)
        self.rows += n
        if len(self.recent) >= self.MOST or self.rows * self.SHARE > self.total:
            old, self.base = self.base, cut(self.whole())
            for table in [] if self.keep else [old, *self.recent[:-1]]:
                discard(table)
            self.recent, self.rows = [], 0
        return n


def vertex_map(graph: Graph, state: DataFrame, update: Column) -> DataFrame:
    """id, value, changed: active vertices (`changed`) take the value of `update`, over id and value; active next are the out-neighbours of those that it changed."""
    value = F.when(F.col("changed"), update).otherwise(F.col("value"))
    told = cut(state.select("id", value.alias("value"), (F.col("changed") & ~value.eqNullSafe(F.col("value"))).alias("moved")))
    reached = graph.edges.join(told.where("moved").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return told.join(reached.withColumn("reached", F.lit(True)), "id", "left").select("id", "value", F.coalesce("reached", F.lit(False)).alias("changed"))


#: Rows of a piece of a fragment, about.
PIECE_ROWS = 1_000_000


def active_map(fragments: DataFrame, kernel: Callable[[int, pa.Table], pa.Table], schema: str, merge: Callable[[int, pa.Table], pa.Table] | None = None, by: str = "src") -> DataFrame:
    """The rows that a caller's kernel of (gid, the fragment's rows) gives for every fragment.

    With `merge` any number of tasks share a fragment: the kernel is given pieces of about PIECE_ROWS rows, all rows of a value of `by`
    in one piece, and merge makes a fragment's rows of those of its pieces.  Without it a fragment is one task's work.
    """
    if merge is None:
        return fragments.groupBy("gid").applyInArrow(lambda k, t: kernel(k[0].as_py(), t), schema)
    n = max(1, -(-fragments.count() // PIECE_ROWS))
    pieces = fragments.withColumn("_piece", F.pmod(F.xxhash64(by), F.lit(n))).groupBy("gid", "_piece").applyInArrow(lambda k, t: kernel(k[0].as_py(), t.drop_columns("_piece")), schema)
    return pieces.groupBy("gid").applyInArrow(lambda k, t: merge(k[0].as_py(), t), schema)


def parallel_do(spark: SparkSession, n: int, kernel: Callable[[int, int], pa.RecordBatch], schema: str) -> DataFrame:
    """The rows that a kernel of (number, n) gives for each of n tasks, without a graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield kernel(i, n)

    return spark.range(n, numPartitions=n).mapInArrow(run, schema)
