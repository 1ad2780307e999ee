"""Components by contraction: rounds move only what is not yet whole."""

import random

import pytest

from graphloom.model import Graph
from graphloom.operators import algorithms as alg
from graphloom.operators import contraction
from graphloom.operators.contraction import star_components


def mixed(seed):
    """Edges of paths, cycles, trees, loops and repeats, ids in no order."""
    rnd = random.Random(seed)
    ids = rnd.sample(range(-1_000, 100_000), 700)
    edges = [e for at in range(0, 500, 10) for e in zip(ids[at : at + 9], ids[at + 1 : at + 10])]
    edges += list(zip(ids[500:560], [*ids[501:560], ids[500]])) + [(ids[560 + (i - 1) // 2], ids[560 + i]) for i in range(1, 100)] + [(ids[690], ids[690]), (ids[3], ids[2]), (ids[3], ids[2]), (ids[5], ids[515])]
    return edges + [(rnd.choice(ids[660:680]), rnd.choice(ids[660:680])) for _ in range(50)]


def fixpoint(edges, best):
    out = {i: i for e in edges for i in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            x = best(out[a], out[b])
            moved, out[b] = moved or x != out[b], x
    return out


@pytest.mark.parametrize("small", [0, 500_000])
def test_components_lay_leaves_aside(spark, monkeypatch, small):
    monkeypatch.setattr(contraction, "SMALL", small)
    edges = mixed(3)
    frame = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    want = fixpoint(edges + [(b, a) for a, b in edges], min)
    found = star_components(frame, limit=60).collect()
    assert {r.id: r.component for r in found} == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in edges)} and len(found) == len({r.id for r in found})
    labels = alg.connected_components(Graph(frame)).collect()
    assert {r.id: r.label for r in labels} == want and len(labels) == len(want)


def test_a_round_moves_what_is_not_whole(spark, monkeypatch):
    """Stars that one task has made whole take part in no star step."""
    seen, step = [], contraction._large_star
    monkeypatch.setattr(contraction, "_large_star", lambda e: seen.append(e.count()) or step(e))
    paths = spark.range(8_100, numPartitions=3).where("id % 9 < 8").selectExpr("id as src", "id + 1 as dst")
    assert star_components(paths, limit=500).where("component <> id - id % 9").count() == 0
    assert sum(seen) < 500  # of 7,200 edges
