"""A left join whose heavy keys meet the table by broadcast gives what a plain one gives."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import _joins


@pytest.mark.parametrize("held", [None, "n"])
@pytest.mark.parametrize("heavy", [1, 3, 1000])
def test_left_join(spark, monkeypatch, held, heavy):
    monkeypatch.setattr(_joins, "HEAVY", heavy)
    keys = [("hot", 1)] * 60 + [("warm", 2)] * 20 + [(None, 1)] * 40 + [("x", None)] * 5 + [(f"k{i}", i) for i in range(30)]
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "id long, a string, b int")
    counts = rows.groupBy("a", "b").agg(F.count("*").alias("n")).where("a is not null and b is not null")
    table = counts.where("b <> 7").select("a", "b", "n", F.concat("a", "b").alias("value"))  # one key has no row
    got = sorted((tuple(r) for r in _joins.left_join(rows, table, ["a", "b"], held).select("id", "a", "b", "n", "value").collect()), key=str)
    want = sorted((tuple(r) for r in rows.join(table, ["a", "b"], "left").select("id", "a", "b", "n", "value").collect()), key=str)
    assert got == want and len(got) == len(keys)


def test_empty_sides(spark):
    rows, table = spark.createDataFrame([], "a string, id int"), spark.createDataFrame([], "a string, v int")
    assert _joins.left_join(rows, table, ["a"]).columns == ["a", "id", "v"] and _joins.left_join(rows, table, ["a"]).count() == 0
    some = spark.createDataFrame([("x", 1), (None, 2)], "a string, id int")
    assert sorted(tuple(r) for r in _joins.left_join(some, table, ["a"]).select("id", "v").collect()) == [(1, None), (2, None)]
