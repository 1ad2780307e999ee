"""Fixpoints that move only what tasks can't settle by themselves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import algorithms as alg
from graphloom.plans import inparts, superstep
from graphloom.plans.inparts import settle_in_parts, settled

from .test_contraction import fixpoint, mixed


@pytest.mark.parametrize("combine", ["min", "max"])
@pytest.mark.parametrize("steps", [1, 3, 500])
def test_in_memory(combine, steps):
    edges = mixed(1)
    src, dst = (np.array(x) for x in zip(*edges))
    ids, value, least, more = settled(src, dst, src, dst, combine, steps)
    want, components = fixpoint(edges, min if combine == "min" else max), fixpoint(edges + [(b, a) for a, b in edges], min)
    assert dict(zip(ids.tolist(), least.tolist())) == components
    assert all(more[i] or value[i] == want[int(ids[i])] for i in range(len(ids)))
    assert steps < 500 or not more.any()


@pytest.mark.parametrize("combine", ["min", "max"])
@pytest.mark.parametrize("order", ["as made", "shuffled"])
@pytest.mark.parametrize("limit, steps", [(100, 500), (1_000, 2), (10_000, 500)])
def test_programs_start_with_what_tasks_settle(spark, monkeypatch, combine, order, limit, steps):
    monkeypatch.setattr(inparts, "TASK_EDGES", limit)
    monkeypatch.setattr(inparts, "TASK_STEPS", steps)
    edges = mixed(2)
    if order == "shuffled":
        random.Random(0).shuffle(edges)
    g = Graph(spark.createDataFrame(edges, "src long, dst long").coalesce(2))
    program = superstep.Program(F.col("id"), F.col("value"), combine, (F.least if combine == "min" else F.greatest)("value", "msg"))
    out = superstep.run(g, program, None, contract_after=2).state.collect()
    want = fixpoint(edges, min if combine == "min" else max)
    assert {r.id: r.value for r in out} == want and len(out) == len(want)


def test_edges_that_lie_together_take_no_steps(spark, monkeypatch):
    monkeypatch.setattr(superstep, "settle", lambda *a: pytest.fail("contracted"))
    paths = spark.range(8_100, numPartitions=3).where("id % 9 < 8").selectExpr("id as src", "id + 1 as dst")
    found = superstep.run(Graph(paths), alg.least_label_program(), None, contract_after=3)
    assert found.steps == 0 and found.state.where("value <> id - id % 9").count() == 0 and found.state.count() == 8_100
    assert alg.min_ancestor_label(Graph(paths).both_ways()).where("label <> id - id % 9").count() == 0
    done, rest, left = settle_in_parts(superstep.cut(paths), F.col("id"), "min", limit=1_000)
    assert rest.count() < 500 and left.count() < 500 and done.count() + rest.count() == 8_100
