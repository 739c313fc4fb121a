"""Covers and numbers of guides, against plain Python."""

from __future__ import annotations

import random

import pytest

from strandline.operators import coverage as cov
from strandline.operators.sequences import named_guides

HIT = "grna string, target_id string, start int, end int, sense string, target_len int"


def random_hits(n_guides: int, n_targets: int, seed: int):
    rng = random.Random(seed)
    rows = [(f"g{rng.randrange(n_guides)}", f"t{rng.randrange(n_targets)}", s := rng.randrange(50), s + 20, rng.choice("+-"), 100) for _ in range(n_guides * 5)]
    return rows + rows[:20]


def plain_sets(rows, n_sets, whole_pos=False):
    """Most uncovered targets, then nearest to 5' on those (or on all), then fewest covered
    ones among its targets, then by name."""
    at, out = {}, []
    for g, t, start, end, sense, size in rows:
        at.setdefault(g, {}).setdefault(t, []).append(size - end if sense == "-" else start)
    universe = {t for ts in at.values() for t in ts}

    def key(g, left):
        on = [p for t, ps in at[g].items() for p in ps if whole_pos or t in left]
        return -len(at[g].keys() & left), sum(on) / len(on) if at[g].keys() & left else 0, len(at[g].keys() - left), g

    for i in range(1, n_sets + 1):
        left, chosen = set(universe), []
        while left and at:
            g = min(at, key=lambda g: key(g, left))
            if not at[g].keys() & left:
                break
            chosen.append(g)
            left -= at[g].keys()
        if left:
            break
        out += [(i, g) for g in chosen]
        at = {g: s for g, s in at.items() if g not in chosen}
    return sorted(out)


@pytest.mark.parametrize(("candidates", "pairs"), [(4_096, 500_000), (7, 500_000), (30, 12)])
def test_cover_in_rounds_equals_the_greedy_cover(spark, monkeypatch, candidates, pairs):
    monkeypatch.setattr(cov, "CANDIDATES", candidates)
    monkeypatch.setattr(cov, "PAIRS", pairs)
    rows = random_hits(60, 25, candidates)
    found = cov.exclusive_sets(spark.createDataFrame(rows, HIT), 2).collect()
    assert sorted(map(tuple, found)) == plain_sets(rows, 2)
    found = cov.exclusive_sets(spark.createDataFrame(rows, HIT), 2, algorithm="greedy").collect()
    assert sorted(map(tuple, found)) == plain_sets(rows, 2, whole_pos=True)


@pytest.mark.parametrize("algorithm", ["LAR", "greedy"])
def test_guides_of_one_target_are_picked_at_once(spark, monkeypatch, algorithm):
    monkeypatch.setattr(cov, "CANDIDATES", 5)
    rounds, opened = [], cov._open
    monkeypatch.setattr(cov, "_open", lambda *a, **k: rounds.append(k["sums"]) or opened(*a, **k))
    rng = random.Random(9)
    rows = [(f"g{t}{i}", f"t{t}", s := rng.randrange(5), s + 20, "+", 100) for t in range(40) for i in range(3)]
    rows += [("wide", f"t{t}", 3, 23, "+", 100) for t in range(3)] + [("g00", "t0", 1, 21, "-", 100)]
    found = cov.exclusive_sets(spark.createDataFrame(rows, HIT), 3, algorithm=algorithm).collect()
    assert sorted(map(tuple, found)) == plain_sets(rows, 3, whole_pos=algorithm == "greedy") and len(found) > 3 * 37
    assert rounds.count(True) <= 6  # one pick of 5 candidates a round were 24


def test_rounds_do_not_write_the_pairs_anew(spark, monkeypatch):
    written, store = [], cov.stored
    monkeypatch.setattr(cov, "CANDIDATES", 7)
    monkeypatch.setattr(cov, "stored", lambda df, tag, **k: written.append(tag) or store(df, tag, **k))
    rows = random_hits(90, 40, 2)
    found = cov.exclusive_sets(spark.createDataFrame(rows, HIT), 1).collect()
    assert sorted(map(tuple, found)) == plain_sets(rows, 1)
    assert len(written) <= 1 + 6  # the table, and at most each halving of 40 targets


def test_a_guide_of_more_targets_than_may_come_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(cov, "PAIRS", 5)
    rows = [("big", f"t{i}", i, i + 20, "+", 100) for i in range(9)] + random_hits(12, 20, 4)
    for name, whole in (("LAR", False), ("greedy", True)):
        found = cov.exclusive_sets(spark.createDataFrame(rows, HIT), 1, algorithm=name).collect()
        assert sorted(map(tuple, found)) == plain_sets(rows, 1, whole_pos=whole)


def test_targets_that_no_guide_hits_leave_no_set(spark):
    hits = spark.createDataFrame(random_hits(20, 5, 1), HIT)
    more = hits.select("target_id").unionByName(spark.createDataFrame([("lone",)], "target_id string"))
    assert cov.exclusive_sets(hits, 1, targets=more).collect() == []


def test_rejected_guides_leave_and_the_others_return(spark):
    rows = random_hits(60, 10, 5)
    hits, shown = spark.createDataFrame(rows, HIT), []

    def approve(number, guides):
        shown.append((number, tuple(guides)))
        return guides[:1] if len(shown) == 1 else []

    found = sorted(map(tuple, cov.exclusive_sets(hits, 1, approve=approve).collect()))
    bad = shown[0][1][0]
    assert found == plain_sets([r for r in rows if r[0] != bad], 1)


def test_no_cover_of_no_hits(spark):
    assert cov.exclusive_sets(spark.createDataFrame([], HIT), 2).collect() == []


def test_numbers_need_no_window_over_all_rows(spark):
    rows = random_hits(150, 9, 3)
    hits = spark.createDataFrame(rows, HIT)
    groups, names = cov.collapsed(hits), named_guides(hits, ["start", "target_id"])
    for df in (groups, names):
        assert "row_number" not in df._jdf.queryExecution().toString()
    targets, first = {}, {}
    for g, t, start, *_ in rows:
        targets.setdefault(g, set()).add(t)
        first[g] = min(first.get(g, (start, t)), (start, t))
    order = sorted({tuple(sorted(s)) for s in targets.values()}, key=lambda s: (-len(s), s))
    width = len(str(len(order)))
    assert {(r.grna, r.cg) for r in groups.collect()} == {(g, f"cg_{order.index(tuple(sorted(s))) + 1:0{width}}") for g, s in targets.items()}
    by_first = sorted(first, key=lambda g: (first[g], g))
    assert {(r.grna, r.grna_id) for r in names.collect()} == {(g, f"gRNA_{i:03d}") for i, g in enumerate(by_first, 1)}
