"""Prefix sums within keys, hot ones included."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from strandline.operators.prefix import prefix_within


@pytest.mark.parametrize("hot", [0, 400, 2000])
def test_sums_within_keys(spark, hot):
    rng = random.Random(hot)
    rows = [(rng.randrange(40), rng.random(), rng.randrange(-(1 << 63), 1 << 63), "t") for _ in range(500)] + [(17, rng.random(), 1 << 62, None) for _ in range(hot)]
    df = spark.createDataFrame(rows, "k long, o double, m long, other string").repartition(5)
    sums, expected = defaultdict(lambda: [0, 0]), []
    for k, _, m, other in sorted(rows, key=lambda r: r[:2]):
        expected.append((k, m, other, sums[k][0], (sums[k][1] + (1 << 63)) % (1 << 64) - (1 << 63)))
        sums[k] = [sums[k][0] + 1, sums[k][1] + m]
    found = prefix_within(df, "k", ["o"], ["m"], ["k", "m", "other"]).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_no_rows(spark):
    assert prefix_within(spark.createDataFrame([], "k long, m long"), "k", ["m"], ["m"], ["k", "m"]).collect() == []
