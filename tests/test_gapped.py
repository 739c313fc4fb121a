"""Guides within edits of the background: a plain distance table on both strands."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strandline.operators.gapped import PART, _meetings, edit_hits
from tests.test_homology import OTHER, dna, mutated


def ends(guide, text):
    """end -> (least edits, latest start)."""
    row = [(0, -j) for j in range(len(text) + 1)]
    for a in guide:
        new = [(row[0][0] + 1, row[0][1])]
        for j, b in enumerate(text, 1):
            new.append(min((row[j - 1][0] + (a != b), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    return {j: (e, -s) for j, (e, s) in enumerate(row)}


def plain(guides, subjects, most, every_end):
    out = set()
    for g in guides:
        for strand, form in (("+", g), ("-", g.translate(OTHER)[::-1])):
            for name, text in subjects.items():
                found = {e: x for e, x in ends(form, text).items() if x[0] <= most and e > x[1]}
                for e, (edits, start) in found.items():
                    if every_end or min((found[f][0], f) for f in range(e - most, e + most + 1) if f in found) == (edits, e):
                        out.add((g, name, strand, start, e, edits))
    return out


@pytest.mark.parametrize("most,every_end", [(0, True), (1, False), (2, False), (3, True), (3, False)])
def test_equals_plain_distances(spark, most, every_end):
    rng = random.Random(most)
    guides = [dna(rng, n) for n in (20, 20, 23, 17)]
    subjects = {}
    for i in range(12):
        copy = mutated(rng, guides[i % 4], 0.05, 0.12 if most else 0)
        copy = copy.translate(OTHER)[::-1] if i % 3 == 0 else copy
        subjects[f"m{i}"] = dna(rng, rng.choice([0, 1, 30])) + copy + dna(rng, rng.choice([0, 2, 600]))
    subjects |= {"empty": "", "short": guides[0][:5], "exact": guides[0] + guides[2] + "N" * 30 + guides[0][1:]}
    t = spark.createDataFrame(list(subjects.items()), "molecule string, seq string").repartition(3)
    q = spark.createDataFrame([(g,) for g in guides + guides[:1]], "grna string")
    rows = edit_hits(q, t, most, every_end).collect()
    got = [(r.grna, r.molecule, r.strand, r.start, r.end, r.edits) for r in rows]
    assert len(got) == len(set(got)) and set(got) == plain(guides, subjects, most, every_end)
    assert all(r.mismatches + r.gaps == r.edits for r in rows) and (most == 0 or any(r.gaps for r in rows))


def test_no_guides_and_short_guides(spark):
    t = spark.createDataFrame([("m", "ACGTACGT")], "molecule string, seq string")
    assert edit_hits(spark.createDataFrame([], "grna string"), t, 2).collect() == []
    with pytest.raises(ValueError):
        edit_hits(spark.createDataFrame([("AC",)], "grna string"), t, 2)


def test_hits_feed_the_off_target_checks(spark, sf_dir):
    from strandline.plans import catalog
    from strandline.plans import substrate as sub

    rows = catalog.QUERIES["offtarget_gapped"](spark, sf_dir).collect()
    subjects = {r.molecule: r.seq for r in sub.molecules(spark, sf_dir).collect()}
    for r in rows[:200]:
        text = subjects[r.molecule][r.start : r.end]
        form = r.grna if r.strand == "+" else r.grna.translate(OTHER)[::-1]
        assert ends(form, text)[len(text)][0] == r.edits
        assert r.expanded.count("m") == r.mismatches and r.expanded.count("i") + r.expanded.count("d") == r.gaps
    checked = {r.grna: r.background for r in catalog.QUERIES["background_gapped"](spark, sf_dir).collect()}
    exact = {r.grna for r in rows if r.edits == 0}
    assert exact and {True, False} == set(checked.values())


def test_texts_of_meetings_are_not_shuffled(spark):
    guides = spark.createDataFrame([("ACGTTGCAACGTGATCCGAT",)], "grna string")
    subjects = spark.createDataFrame([("m", "TTACGTTGCAACGTGATCCGATTT")], "molecule string, seq string")
    plan = edit_hits(guides, subjects, 2)._jdf.queryExecution().executedPlan().toString().split("\n")
    dealt = [x for x in plan if "Exchange" in x]
    assert dealt and not any("form#" in x and "from#" in x for x in dealt)


def test_few_pairs_are_measured_and_no_near_one_is_lost():
    rng = np.random.default_rng(4)
    letters, most, m, cuts = np.frombuffer(b"ACGT", np.uint8), 2, 20, [0, 4, 8, 12, 16, 20]
    side = m + most
    guides, texts = letters[rng.integers(0, 4, (3_000, m))], letters[rng.integers(0, 4, (3_000, 2 * side + PART))]
    guides[:, :4] = texts[:, side : side + 4] = letters[0]
    for i in range(0, 3_000, 10):  # a guide with two edits behind its first part
        near = guides[i].tolist()
        a, b = sorted(rng.integers(4, m, 2).tolist(), reverse=True)
        for at in (a, b):
            near[at : at + 1] = [[], [int(rng.choice(letters))], [near[at], int(rng.choice(letters))]][rng.integers(3)]
        texts[i, side : side + len(near)] = near
    measured = {pair for a, b in _meetings(guides, texts, 0, side, cuts, most) for pair in zip(a.tolist(), b.tolist(), strict=True)}
    assert {(i, i) for i in range(0, 3_000, 10)} <= measured
    assert len(measured) < 3_000 * 3_000 / 5_000


def test_guides_and_background_meet_in_groups(spark, sf_dir):
    """No join writes out a row for each of the many pairs that share a few letters."""
    from strandline.plans import catalog

    for name in ("offtarget_gapped", "background_gapped"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "[seed" not in "".join(x for x in plan.split("\n") if "Join" in x)
