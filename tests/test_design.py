"""Whole designs against plain versions: checks, sets, files, tie-breakers, found targets."""

from __future__ import annotations

import random
import re

import pytest

from strandline.functions.parameters import Design
from strandline.operators import coverage as cov
from strandline.operators import covers as cvs
from strandline.operators import design as des
from strandline.sources.registry import registered
from strandline.sources.text import read_fasta, read_map

OTHER = str.maketrans("ACGT", "TGCA")
turned = lambda s: s.translate(OTHER)[::-1]
dna = lambda n, seed: "".join(random.Random(seed).choices("ACGT", k=n))


@pytest.fixture(scope="module")
def sequences():
    shared = dna(60, 1)
    targets = {f"t{i}": dna(80, 10 + i) + shared + dna(80, 20 + i) for i in range(4)}
    # the background holds one whole target (masked), a stretch of another, and one of it changed
    changed = list(targets["t2"][:70])
    for at in range(5, 70, 17):
        changed[at] = "A" if changed[at] != "A" else "C"
    background = {"m1": dna(50, 2) + targets["t0"] + dna(30, 3), "m2": dna(40, 4) + turned(targets["t1"][70:190]) + "".join(changed)}
    return targets, background


def plain_guides(targets):
    found = {}
    for t, s in targets.items():
        for strand, x in (("+", s), ("-", turned(s))):
            for m in re.finditer(r"(?=(.{20})[ACGT]GG)", x):
                start = m.start() if strand == "+" else len(s) - m.start() - 20
                found.setdefault(m[1], set()).add((t, start, strand))
    return found


def plain_bad(guides, background, targets, most, motif):
    bad = set()
    hidden = [(m, i, i + len(t)) for m, s in background.items() for t in (*targets.values(), *map(turned, targets.values())) for i in range(len(s)) if s.startswith(t, i)]
    for m, s in background.items():
        for strand, x in (("+", s), ("-", turned(s))):
            for i in range(len(x) - 19):
                start = i if strand == "+" else len(s) - i - 20
                if any(h == m and a <= start and start + 20 <= b for h, a, b in hidden):
                    continue
                w = x[i : i + 20]
                if motif and not re.match("[ACGT]GG", x[i + 20 : i + 23]):
                    continue
                bad |= {g for g in guides if sum(a != b for a, b in zip(g, w, strict=True)) <= most}
    return bad


def plain_cover(hits):
    """The LAR cover: most uncovered targets, nearest to 5' on them, least redundant, by name."""
    left, out = {t for v in hits.values() for t, *_ in v}, []
    while left:

        def key(g, left=left):
            on = [s for t, s, _ in hits[g] if t in left]
            new = {t for t, *_ in hits[g]} & left
            return (-len(new), sum(on) / len(on) if on else 0.0, len({t for t, *_ in hits[g]}) - len(new), g)

        best = min(hits, key=key)
        out.append(best)
        left -= {t for t, *_ in hits[best]}
    return out


def frames(spark, targets, background):
    t = spark.createDataFrame(list(targets.items()), "target_id string, seq string")
    return t, spark.createDataFrame([("b", m, s) for m, s in background.items()], "source string, molecule string, seq string")


@pytest.mark.parametrize(("design", "most", "motif"), [(Design(accept_unset=True, cover_reachable=True), 0, False), (Design(accept_unset=True, cover_reachable=True, offtarget_pamless=False), 0, True)])
def test_checks_and_sets(spark, sequences, design, most, motif):
    targets, background = sequences
    result = des.designed(*frames(spark, targets, background)[:1], design, frames(spark, targets, background)[1])
    guides = plain_guides(targets)
    bad = plain_bad(guides, background, targets, most, motif)
    gc = {g: 0.3 <= sum(c in "GC" for c in g) / 20 <= 0.7 for g in guides}
    got = {r["grna"]: (r["GC"], r["background"]) for r in result.guides.collect()}
    assert bad and bad != set(guides) and got == {g: (gc[g], g not in bad) for g in guides}
    ids = sorted(r["grna_id"] for r in result.guides.collect())
    assert ids == [f"gRNA_{i:03d}" for i in range(1, len(guides) + 1)]
    assert {(r["grna"], r["target_id"], r["start"], r["strand"]) for r in result.hits.collect()} == {(g, *h) for g, v in guides.items() for h in v}
    good = {g: v for g, v in guides.items() if gc[g] and g not in bad}
    assert [r["grna"] for r in result.sets.collect()] == plain_cover(good)
    assert {r[0] for r in des.uncovered(result).collect()} == {t for v in guides.values() for t, *_ in v} - {t for v in good.values() for t, *_ in v}


def test_exact_places_of_guides_on_both_strands(spark):
    """Guides in lower case, twice, with a U, equal to their other strand, null and of another length, against a plain search."""
    plain = dna(20, 31)
    guides = [plain, plain.lower(), turned(dna(20, 32)), "ACGTACGTACACGTACGTAC"[:10] + turned("ACGTACGTAC"), "U" + dna(19, 33), "T" + dna(19, 33), dna(12, 34), None]
    molecules = {"a": plain + "AA" + turned(plain) + plain, "b": dna(20, 32) + guides[3] + guides[4] + "g" * 20, "c": "T" + dna(19, 33) + turned("T" + dna(19, 33)), "d": plain[:19], "e": None}
    found = des.background_hits(spark.createDataFrame([(g,) for g in guides], "grna string").repartition(3), spark.createDataFrame(list(molecules.items()), "molecule string, seq string"), 0)
    turn = lambda s: s.translate(str.maketrans("ACGTU", "TGCAA"))[::-1]
    expected = {(g, m, strand, at, at + 20) for g in {g.upper() for g in guides if g and len(g) == 20} for m, s in molecules.items() if s for strand, form in (("+", g), ("-", turn(g))) for at in range(len(s) - 19) if s[at : at + 20].upper() == form}
    rows = [(r.grna, r.molecule, r.strand, r.start, r.end) for r in found.collect()]
    assert len(rows) == len(expected) >= 9 and set(rows) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(either#" in plan and not any("form#" in x for x in plan.split("\n") if "Exchange" in x)  # a guide is one row


def test_mismatches_and_gaps_take_effect(spark, sequences):
    targets, background = sequences
    t, b = frames(spark, targets, background)
    guides = plain_guides(targets)
    failing = lambda d: {r["grna"] for r in des.designed(t, d, b).guides.where("not background").collect()}
    none, two = failing(Design(accept_unset=True)), failing(Design(accept_unset=True, offtarget_mismatch=3))
    assert none == plain_bad(guides, background, targets, 0, False) and none < two
    # a guide that hangs over a molecule's end is met besides those without gaps
    assert plain_bad(guides, background, targets, 2, False) <= two
    gapped = failing(Design(accept_unset=True, offtarget_gap=2))
    assert none <= gapped and plain_bad(guides, background, targets, 0, False) <= gapped
    pattern = failing(Design(accept_unset=True, offtarget_pattern="0mg-12", offtarget_edits=1))
    seeds = {g for g in guides for s in (*background.values(), *map(turned, background.values())) if g[8:] in s}
    assert none <= pattern <= seeds


def test_an_inserted_base_counts_as_a_gap(spark):
    guide = "ACGTTGCAACGGATCTTGCA"
    t = spark.createDataFrame([("t", "TTT" + guide + "AGGTT")], "target_id string, seq string")
    b = spark.createDataFrame([("b", "m", dna(40, 5) + guide[:10] + "A" + guide[10:] + dna(40, 6))], "source string, molecule string, seq string")
    check = lambda d: {r["grna"]: r["background"] for r in des.designed(t, d, b).guides.collect()}[guide]
    assert check(Design(accept_unset=True)) and check(Design(accept_unset=True, offtarget_mismatch=2))
    assert not check(Design(accept_unset=True, offtarget_gap=2))


def test_files_in_and_out(spark, sequences, tmp_path):
    targets, background = sequences
    fasta = lambda rows: "".join(f">{k} about\n{v}\n" for k, v in rows.items())
    (tmp_path / "t.fa").write_text(fasta(targets))
    (tmp_path / "b.fa").write_text(fasta(background))
    guides = sorted(plain_guides(targets))
    (tmp_path / "x.fa").write_text(f">no\n{guides[0].lower()}\n")
    result = des.full(spark, Design(prefix="mine", sets=2, accept_unset=True), str(tmp_path / "out"), targets=str(tmp_path / "t.fa"), background=[str(tmp_path / "b.fa")], exclude=str(tmp_path / "x.fa"))
    assert [r["grna"] for r in result.guides.where("not exclude").collect()] == [guides[0]]
    out = str(tmp_path / "out/mine/gRNA_")
    assert {r["grna"] for r in read_map(spark, out + "all.map").collect()} == set(guides)
    final = {(r["set"], r["grna"]) for r in read_map(spark, out + "final.map").collect()}
    assert final == {(str(r["set_number"]), r["grna"]) for r in result.sets.collect()}
    assert {r["seq"] for r in read_fasta(spark, out + "pass.fasta").collect()} == {r["grna"] for r in result.passing_guides.collect()}
    with pytest.raises(ValueError, match="either"):
        des.full(spark, Design(), str(tmp_path / "no"))


def test_sources_under_aliases(spark, tmp_path):
    for name, seq in (("a", "ACGT"), ("b", "GGGG")):
        (tmp_path / f"{name}.fa").write_text(f">m\n{seq}\n")
    a, b = str(tmp_path / "a.fa"), str(tmp_path / "b.fa")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(registered(spark, [a, b, a])) == [("query_001", "m", "ACGT"), ("query_002", "m", "GGGG")]
    assert rows(registered(spark, {"x": b, "y": b})) == [("x", "m", "GGGG")] and rows(registered(spark, [])) == []


def test_ranks_break_ties(spark):
    hits = spark.createDataFrame([(g, t, "+", 0, 20, 100) for g, ts in {"a": "12", "b": "12", "c": "3", "d": "3", "e": "34"}.items() for t in ts], "grna string, target_id string, sense string, start int, end int, target_len int")
    ranks = spark.createDataFrame([("b", 0.5), ("a", 2.0), ("b", 9.0), ("d", 1.0)], "grna string, rank double")
    picked = lambda **k: [r["grna"] for r in cov.exclusive_sets(hits, 1, **k).collect()]
    assert picked() == ["a", "e"] and picked(ranks=ranks) == ["b", "e"]


def test_light_covers_in_bulk(spark, monkeypatch):
    rng = random.Random(7)
    panel = {f"g{i:02d}": sorted(rng.sample(range(60), rng.randint(1, 14))) for i in range(40)}
    left, expected = {t for ts in panel.values() for t in ts}, []
    while left:
        best = min((g for g in panel if left & set(panel[g])), key=lambda g: (len(panel[g]) / len(left & set(panel[g])), -len(panel[g]), g))
        expected.append(best)
        left -= set(panel[best])
    groups = spark.createDataFrame([(g, list(map(str, ts))) for g, ts in panel.items()], "cg string, targets array<string>")
    for most in (4_096, 5):
        monkeypatch.setattr(cvs, "CANDIDATES", most)
        assert [r["cg"] for r in cvs.approximate_cover(groups).orderBy("step").collect()] == expected


def test_targets_found_in_genomes(spark):
    gene, other = dna(300, 30), dna(300, 31)
    near = list(gene)
    for at in range(30, 300, 60):
        near[at] = "A" if near[at] != "A" else "C"
    genomes = {("g1", "c1"): dna(200, 32) + gene + dna(200, 33), ("g2", "c1"): dna(150, 34) + turned("".join(near)) + dna(100, 35) + other}
    table = spark.createDataFrame([(*k, v) for k, v in genomes.items()], "source string, molecule string, seq string")
    genes = spark.createDataFrame([("G", gene)], "gene string, seq string")
    found = {r["target_id"]: r["seq"] for r in des.discovered_targets(genes, table, Design(min_identity=90, min_length=200), coding=genes).collect()}
    assert sorted(k.split("|")[0] for k in found) == ["g1", "g2"]
    for k, seq in found.items():
        source, molecule, _, place = k.split("|")
        start, end = map(int, place.split("-"))
        assert genomes[source, molecule][start - 1 : end] == seq and len(seq) >= 290
    reference = spark.createDataFrame([("r", dna(50, 36) + gene + dna(50, 37) + other)], "molecule string, seq string")
    mine, wrong = (spark.createDataFrame([("r", 50, 350, name)], "molecule string, start int, end int, gene string") for name in ("G", "H"))
    checked = lambda a: des.discovered_targets(genes, table, Design(min_identity=90, min_length=200, check_reciprocal=True), reference=reference, annotation=a).count()
    assert (checked(mine), checked(wrong)) == (2, 0)
