"""Progressive alignments, coding rows, and targets added in either direction."""

from __future__ import annotations

import random

import pytest

from strandline.operators import msa
from strandline.operators.alignment import feature_check
from tests.test_homology import OTHER, dna, mutated


def star(seqs):
    """Each sequence aligned with the first; insertions between its columns put side by side."""
    centre, rows = seqs[0], []
    for s in seqs[1:]:
        _, way = msa.paired(msa._counts(msa._matrix([centre])), msa._counts(msa._matrix([s])))
        over, between, at, col = ["-"] * len(centre), [""] * (len(centre) + 1), 0, 0
        for step in way:
            if step == "M":
                over[col] = s[at]
            elif step == "D":
                between[col] += s[at]
            at, col = at + (step != "I"), col + (step != "D")
        rows.append((over, between))
    rows.insert(0, (list(centre), [""] * (len(centre) + 1)))
    width = [max(len(b[c]) for _, b in rows) for c in range(len(centre) + 1)]
    return ["".join(b[c].ljust(width[c], "-") + (o[c] if c < len(centre) else "") for c in range(len(centre) + 1)) for o, b in rows]


def test_rows_give_back_their_sequences_and_beat_a_star():
    rng = random.Random(5)
    for rate, gaps, n in ((0.02, 0.02, 4), (0.1, 0.05, 6), (0.2, 0.1, 5), (0.0, 0.0, 3)):
        base = dna(rng, 200)
        seqs = [mutated(rng, base, rate, gaps) for _ in range(n)]
        seqs[-1] = seqs[-1][:60] + seqs[-1][110:]
        rows = msa.aligned_rows(seqs)
        assert [r.replace("-", "") for r in rows] == seqs and len({len(r) for r in rows}) == 1
        assert not any(set(c) == {"-"} for c in zip(*rows, strict=True))
        assert msa.sum_of_pairs(rows) >= msa.sum_of_pairs(star(seqs))


def test_best_path_of_two_sequences():
    for a, b, expected in (("ACGT", "ACGT", "MMMM"), ("A", "A", "M"), ("ACGTACGTTTGGCC", "ACGTACGTGGCC", 12), ("GGGACGTACGT", "ACGTACGT", 8)):
        score, way = msa.paired(msa._counts(msa._matrix([a])), msa._counts(msa._matrix([b])))
        assert way.count("M") == expected if isinstance(expected, int) else way == expected


def test_coding_rows_and_targets(spark):
    rng = random.Random(8)
    exon, intron = [dna(rng, 120), dna(rng, 90)], dna(rng, 80)
    genes = {"g1": exon[0] + intron + exon[1]}
    genes["g2"] = mutated(rng, exon[0], 0.05) + intron[:50] + mutated(rng, exon[1], 0.05)
    coding = [("s", "g1", "g1.c", 0, 120), ("s", "g1", "g1.c", 200, 290), ("s", "g2", "g2.c", 0, 120), ("s", "g2", "g2.c", 170, 260), ("s", "lost", "x", 0, 10)]
    targets = {f"t{i}": mutated(rng, genes["g1"], 0.08, 0.03) for i in range(70)}
    for i in range(0, 70, 3):
        targets[f"t{i}"] = targets[f"t{i}"].translate(OTHER)[::-1]
    targets["t1"] = targets["t1"][:100] + dna(rng, 40) + targets["t1"][100:]
    targets |= {"g2": "ACGT", "none": ""}
    g = spark.createDataFrame([("s", k, v) for k, v in genes.items()] + [("one", "g9", "ACGTACGT"), ("s", "empty", "")], "aln_id string, seq_id string, seq string")
    c = spark.createDataFrame(coding, "aln_id string, seq_id string, cds_id string, start int, end int")
    t = spark.createDataFrame([("s", k, v) for k, v in targets.items()] + [("without", "t", "ACGT")], "aln_id string, seq_id string, seq string")
    reference = msa.aligned_references(g, c)
    rows = {(r.aln_id, r.seq_id): r for r in reference.collect()}
    assert set(rows) == {("s", "g1"), ("s", "g2"), ("s", "g1.c"), ("s", "g2.c"), ("one", "g9")}
    assert rows["s", "g1.c"].aln.replace("-", "") == exon[0] + exon[1] and rows["s", "g1.c"].kind == "cds"
    assert all(a == b for a, b in zip(rows["s", "g1.c"].aln, rows["s", "g1"].aln, strict=True) if a != "-")
    whole = msa.added_targets(reference, t)
    found = {r.seq_id: r.aln for r in whole.where("aln_id = 's'").collect()}
    assert len({len(a) for a in found.values()}) == 1
    assert {k for k in found if k.startswith("_R_")} == {f"_R_t{i}" for i in range(0, 70, 3)}
    for k, a in found.items():
        bare, name = a.replace("-", ""), k.removeprefix("_R_")
        if name in targets and name != "g2":
            assert bare == (targets[name].translate(OTHER)[::-1] if name != k else targets[name])
        elif name in genes:
            assert bare == genes[name]
    # a guide in the first exon of a turned target lies within the feature, one in the intron does not
    n = len(targets["t0"])
    hits = spark.createDataFrame([("a", "t0", n - 60, n - 40, n), ("b", "t0", n - 165, n - 145, n)], "hit_id string, target_id string, start int, end int, target_len int")
    checked = {r.hit_id: r.feature for r in feature_check(hits, whole, c.where("seq_id <> 'lost'").select("aln_id", "seq_id", "start", "end")).collect()}
    assert checked == {"a": True, "b": False}


def test_too_many_references(spark):
    g = spark.createDataFrame([("s", f"g{i}", "ACGT") for i in range(msa.MOST_REFERENCES + 1)], "aln_id string, seq_id string, seq string")
    with pytest.raises(Exception, match="too many"):
        msa.aligned_references(g, spark.createDataFrame([], "aln_id string, seq_id string, cds_id string, start int, end int")).collect()


def test_pairs_at_once_are_those_alone():
    rng = random.Random(11)
    profiles = [msa._counts(msa._matrix(msa.aligned_rows([mutated(rng, dna(rng, 60), 0.1, 0.05) for _ in range(n)]))) for n in (1, 2, 3)]
    singles = [msa._counts(msa._matrix([dna(rng, n)])) for n in (1, 7, 55, 60, 61, 200)]
    pairs = [(a, b) for a in profiles for b in singles]
    assert msa.all_paired(pairs) == [msa.paired(a, b) for a, b in pairs]


def test_alignments_are_made_once(spark, sf_dir):
    from strandline.plans import catalog

    plan = catalog.QUERIES["align_targets"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("FlatMap", "MapInArrow", "supplier.parquet"))
