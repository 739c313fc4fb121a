"""Off-target hits of all guides on both strands, against brute force."""

from __future__ import annotations

import numpy as np

from strandline.operators.search import _near, hamming_hits
from strandline.plans import catalog
from strandline.plans import substrate as sub

OTHER = str.maketrans("ACGT", "TGCA")


def letters(words):
    return np.array([list(w.encode()) for w in words], np.uint8)


def test_all_guides_meet_both_strands(spark, sf_dir):
    both = lambda rows: [s for r in rows for s in (r.seq, r.seq.translate(OTHER)[::-1])]
    targets, molecules = both(sub.targets(spark, sf_dir).collect()), both(sub.molecules(spark, sf_dir).collect())
    guides = sorted({s[i : i + 20] for s in targets for i in range(len(s) - 22) if s[i + 21 : i + 23] == "GG"})
    windows = sorted({s[i : i + 20] for s in molecules for i in range(len(s) - 19)})
    g, expected = letters(guides), set()
    for w, row in zip(windows, letters(windows)):
        n = (g != row).sum(1)
        expected |= {(guides[i], w, int(n[i])) for i in np.flatnonzero(n <= 4)}
    found = [(r.grna, r.w, r.mismatches) for r in catalog.QUERIES["offtarget_hits"](spark, sf_dir).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_any_letters_and_lengths_of_two_longs(spark):
    rng = np.random.default_rng(5)
    for length, most, agree in ((25, 3, 2), (20, 4, 3), (21, 2, 1)):
        seqs = ["".join(rng.choice(list("ACGTNRYa-"), length)) for _ in range(12)]
        near = ["".join(c if rng.random() > 0.12 else rng.choice(list("ACRYg")) for c in s) for s in seqs for _ in range(12)]
        frames = spark.createDataFrame([(s,) for s in seqs], "grna string"), spark.createDataFrame([(s,) for s in [*near, *seqs]], "w string")
        plan = hamming_hits(*frames, length, most, agree)
        assert "seed0#" in plan._jdf.queryExecution().executedPlan().toString()
        count = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
        expected = {(g, w, count(g, w)) for g in seqs for w in {*near, *seqs} if count(g, w) <= most}
        found = [(r.grna, r.w, r.mismatches) for r in plan.collect()]
        assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 12


def test_letters_are_counted_without_patterns(spark, sf_dir):
    """Alignments are written out once, and letters counted by plain replacement."""
    from strandline.plans import catalog

    plan = catalog.QUERIES["ot_pattern_forms"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("transform(") == 1


def test_a_guide_is_dealt_once_for_each_part(spark):
    """Choices of equal pieces are made within a group: no row for each is shuffled."""
    frame = lambda c: spark.createDataFrame([("ACGTTGCAACGTGATCCGAT",)], f"{c} string")
    plan = hamming_hits(frame("grna"), frame("w"), 20, 4, agree=3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    dealt = [x for x in plan.split("\n") if "named_struct" in x or "Generate explode" in x]
    assert dealt and all(x.count(" AS part#") <= 5 and x.count("named_struct(part") <= 5 for x in dealt)


def test_each_pair_is_found_for_one_choice_of_pieces():
    rng = np.random.default_rng(7)
    digits = rng.integers(0, 4, (400, 20))
    digits[200:] = np.where(rng.random((200, 20)) < 0.15, rng.integers(0, 4, (200, 20)), digits[:200])
    codes = (digits.astype(np.int64) << (3 * (19 - np.arange(20)))).sum(1)[:, None]
    cuts, unlike = [0, 4, 8, 12, 16, 20], (digits[:200, None] != digits[None, 200:])
    masks = [[sum(7 << 3 * (19 - p) for p in range(a, b))] for a, b in zip(cuts, cuts[1:], strict=False)]
    same = ~unlike.reshape(200, 200, 5, 4).any(3)
    expected = {(i, j, int(unlike[i, j].sum())) for i, j in np.argwhere((unlike.sum(2) <= 4) & same[:, :, 1] & ~same[:, :, 0]).tolist()}
    found = [x for a, b, n in _near(codes[:200], codes[200:], 20, 4, 3, 1, cuts, masks) for x in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 10
