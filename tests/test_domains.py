"""Domains by score matrices: a plain scan of all windows of all frames."""

from __future__ import annotations

import random
from math import log

from strandline.operators import domains as dm
from strandline.operators.sequences import genetic_code
from tests.test_homology import OTHER, dna


def frames(seq):
    code = genetic_code(1)
    value = lambda c: code[sum("ACGT".index(x) * 4 ** (2 - i) for i, x in enumerate(c))] if set(c) <= set("ACGT") else "X"
    for strand, s in (("+", seq), ("-", seq.translate(OTHER)[::-1])):
        for f in range(3):
            yield strand, f, "".join(value(s[i : i + 3]) for i in range(f, len(s) - 2, 3))


def test_equals_a_plain_scan(spark):
    rng = random.Random(3)
    matrices = {}
    for d in range(5):
        size = (2, 3, 10, 17, 25)[d]
        matrices[f"d{d}"] = [{a: rng.choice([-3, -2, -1, 0, 1]) + (9 if a == best else 0) for a in rng.sample(dm.RESIDUES, 15) + [best]} for best in rng.choices(dm.RESIDUES, k=size)]
    back = {}
    for i, c in enumerate((a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT")):
        back.setdefault(genetic_code(1)[i], c)
    seqs = {}
    for i in range(12):
        m = matrices[f"d{2 + i % 3}"]
        best = "".join(back[max(col, key=col.get)] for col in m)
        if i % 2:
            best = best[:9] + best[9:15].replace("A", "C", 1) + best[15:]
        s = dna(rng, 50 + i) + best + dna(rng, 40)
        seqs[f"t{i}"] = s.translate(OTHER)[::-1] if i % 3 == 0 else s
    seqs |= {"n": "NNN" * 20, "short": "AC", "empty": ""}
    t = spark.createDataFrame(list(seqs.items()), "target_id string, seq string").repartition(3)
    m = spark.createDataFrame([(d, p, a, float(x)) for d, cols in matrices.items() for p, col in enumerate(cols) for a, x in col.items()], "domain string, pos int, residue string, score double")
    peptides = dm.six_frames(t)
    read = {(name, *x[:2]): x[2] for name, s in seqs.items() for x in frames(s)}
    assert {(r.target_id, r.strand, r.frame): r.peptide for r in peptides.collect()} == read
    total = sum(map(len, read.values()))
    expected = set()
    for d, cols in matrices.items():
        least = (log(len(cols) * total * dm.WEIGHT) - log(0.01)) / dm.RATE
        for (name, strand, f), p in read.items():
            for at in range(len(p) - len(cols) + 1):
                score = sum(col.get(a, -4) for col, a in zip(cols, p[at:], strict=False))
                if score >= least and len(cols) >= 3:
                    expected.add((d, name, strand, f, at, score))
    hits = dm.domain_hits(m, peptides)
    got = [(r.domain, r.target_id, r.strand, r.frame, r.at, r.score) for r in hits.collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len({d for d, *_ in expected}) == 3
    for r in dm.domain_ranges(hits, peptides).collect():
        piece = seqs[r.target_id][r.start : r.end]
        assert len(piece) == 3 * len(matrices[r.domain])


def test_a_word_with_an_unknown_residue_may_be_the_one_that_reaches_its_share(spark):
    strong, weak = {"W": 90.0}, {"A": 1.0}
    cols = [strong, weak, strong, weak, weak, weak]
    m = spark.createDataFrame([("d", p, a, x) for p, col in enumerate(cols) for a, x in col.items()], "domain string, pos int, residue string, score double")
    peptides = spark.createDataFrame([("t", "+", 0, 18, "WXWGGG")], "target_id string, strand string, frame int, n int, peptide string")
    assert [(r.at, r.score) for r in dm.domain_hits(m, peptides).collect()] == [(0, 180.0 - 16.0)]


def test_words_of_five_where_they_are_few(spark):
    rows = [("d", 40.0, [8.0 if a == p % 20 else -4.0 for p in range(10) for a in range(20)]), ("flat", 1.0, [1.0] * 200)]
    found = dm._words(spark.createDataFrame(rows, "domain string, least double, scores array<double>"))
    assert {(r.domain, len(r.seed)) for r in found.select("domain", "seed").collect()} == {("d", 5), ("flat", 3)}


def test_meetings_are_scored_within_groups(spark):
    """No row for each meeting of a word is shuffled: matrices and peptides are dealt, and that is all."""
    m = spark.createDataFrame([("d", p, "W", 90.0) for p in range(6)], "domain string, pos int, residue string, score double")
    peptides = spark.createDataFrame([("t", "+", 0, 24, "WWWWWWWW")], "target_id string, strand string, frame int, n int, peptide string")
    hits = dm.domain_hits(m, peptides)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan and "Aggregate" not in plan
    assert sorted((r.at, r.score) for r in hits.collect()) == [(i, 540.0) for i in range(3)]
