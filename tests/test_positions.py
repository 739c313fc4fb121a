"""Positions of ranges and back, against plain sets."""

from __future__ import annotations

from strandline.operators import ranges as rg


def test_positions_in_any_order(spark):
    rows = [("a", p) for p in (5, 6, 7, 7, 3, 4, 20, 9, 22, 21, -1, 0)] + [("b", 8), ("b", 7), (None, 1), (None, 2)]
    found = rg.to_ranges(spark.createDataFrame(rows, "k string, pos int").repartition(3), ["k"])
    assert {tuple(r) for r in found.collect()} == {("a", 3, 8), ("a", 9, 10), ("a", 20, 23), ("a", -1, 1), ("b", 7, 9), (None, 1, 3)}


def test_positions_are_not_shuffled(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 3, 9), ("b", 4, 4), ("b", 6, 8), ("a", 9, 10)], "k string, start int, end int")
    positions = rg.to_positions(rows, ["k"])
    assert sorted(map(tuple, positions.collect())) == [("a", p) for p in range(1, 10)] + [("b", 6), ("b", 7)]
    for plan in (positions, rg.to_ranges(positions, ["k"])):
        lines = plan._jdf.queryExecution().executedPlan().toString().split("\n")
        shuffles = [x for x in lines if "Exchange" in x]
        assert shuffles and not any("pos#" in x for x in shuffles)
