"""Grammars, parameters, layouts and set searches on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.functions.pam import Pam
from strandline.functions.parameters import Design, parsed_renames, read_config
from strandline.functions.patterns import off_target, position_range
from strandline.operators import covers as cvs
from strandline.operators import features as ft
from strandline.operators import records as rec
from strandline.operators import search as sr
from strandline.operators import sequences as sq
from strandline.sources import text as src
from strandline.streaming.guides import guide_stream


@pytest.mark.parametrize(
    ("text", "expected"),
    [("", (1, 20, False)), ("5", (1, 5, False)), ("5-", (5, 20, False)), ("2-5", (2, 5, False)), ("-5", (16, 20, True)), ("-5-", (1, 16, True)), ("-2--5", (16, 19, True)), ("-5--2", (16, 19, True))],
)
def test_documented_ranges(text, expected):
    assert position_range(text, 20) == expected


@pytest.mark.parametrize("text", ["0", "0-5", "2--5", "-5-2", "x", "1-0"])
def test_ranges_that_are_none(text):
    with pytest.raises(ValueError, match="."):
        position_range(text, 20)


def test_left_to_right_without_precedence(spark):
    row = spark.createDataFrame([("..m.d..i.. ",)], "x string")
    ahead, back = sr.btop_positions(F.col("x")), sr.btop_positions(F.col("x"), from_end=True)
    got = row.select(off_target("0m2,(0i-3|0d4)", ahead, 10, back).alias("a"), off_target("0m3|1g,0d", ahead, 10, back).alias("b"), off_target("1d-7,0i2", ahead, 10, back).alias("c")).first()
    assert tuple(got) == (True, False, True)


@pytest.mark.parametrize(
    ("text", "pattern"),
    [("SpCas9", ".NGG"), ("aaccas12b", "TTN."), ("BhCas12b", "DTTN."), ("TTTV", ".NTTTV"), ("NGG", ".NGG"), ("TTN", "TTN."), ("TTNV", "TTNV."), ("ATV.", "ATV."), ("NNA", ".NNA")],
)
def test_place_of_the_guide(text, pattern):
    assert Pam.parse(text).pattern == pattern


def test_pattern_of_single_strings():
    import re

    assert [m.start() for m in re.finditer(f"(?={Pam.parse('NGG', 4).regex})", "ACGTTGGACGTAGG")] == [0, 7]


def test_parameters(tmp_path):
    (tmp_path / "c.ini").write_text("[general]\nprefix = mine\nsets = 3\n[filter]\ngc-min = 0.2\ncheck_reciprocal = yes\n[lookup]\nath = a.fa\n[ref]\nrenames = mRNA:Parent=Locus_id\n")
    design, others = read_config(str(tmp_path / "c.ini"))
    assert (design.prefix, design.sets, design.gc_min, design.check_reciprocal, design.length) == ("mine", 3, 0.2, True, 20)
    assert design.renames == {"mRNA": {"Parent": "Locus_id"}} and others == {"lookup": {"ath": "a.fa"}}
    for wrong in ({"length": 0}, {"gc_max": 1.5}, {"max_insertion": -1}, {"set_cover": "x"}, {"gc_min": 0.8}):
        with pytest.raises(ValueError, match="."):
            Design(**wrong)
    assert parsed_renames("") == {} and parsed_renames("a:b=c,d=e;all:f=g") == {"a": {"b": "c", "d": "e"}, "all": {"f": "g"}}


KIND = "grna_id string, grna string, target_id string, target_len int, sense string, strand string, start int, end int, set string, checks map<string,boolean>"


@pytest.mark.parametrize("version", [1, 2, 3, 4, 5])
def test_layouts_of_guide_maps(spark, tmp_path, version):
    made = spark.createDataFrame([("g1", "ACGT", "t1", 90, "sense", "-", 4, 8, "1", {"GC": True, "own": None}), ("g2", "AAAA", "t2", 80, "NA", "+", 0, 4, "2", {"GC": False, "own": True})], KIND)
    src.write_map(made, str(tmp_path / "m"), ["GC", "own"], version)
    size = {"t1": 90, "t2": 80} if version in (3, 5) else {"t1": 0, "t2": 0}
    expected = {r["grna_id"]: r.asDict() | {"target_len": size[r["target_id"]]} for r in made.collect()}
    assert {r["grna_id"]: r.asDict() for r in src.read_map(spark, str(tmp_path / "m")).collect()} == expected
    targets = spark.createDataFrame([("t1", "A" * 70)], "target_id string, seq string")
    assert {r["target_id"]: r["target_len"] for r in src.read_map(spark, str(tmp_path / "m"), targets).collect()} == size | {"t1": 70}


def test_family_of_outputs(spark, tmp_path):
    hits = spark.createDataFrame([("g1", "ACGT", "t1", 90, "sense", "-", 4, 8, "1", {"GC": True})], KIND)
    guides, groups = hits.select("grna_id", "grna"), spark.createDataFrame([("cg_1", "ACGT", 1)], "cg string, grna string, n_targets int")
    paths = src.write_outputs("pass", str(tmp_path), guides, hits, groups, spark.createDataFrame([("ACGT", 4.0)], "grna string, pos double"), ["GC"])
    assert src.read_map(spark, paths[0]).count() == 1 and src.read_fasta(spark, paths[1]).first()["seq"] == "ACGT" and src.read_table(spark, paths[2]).count() == 1
    src.write_guides(guides.unionByName(spark.createDataFrame([("g9", "TTTT")], guides.schema)), str(tmp_path / "some"), only=spark.createDataFrame([("g9",)], "grna_id string"))
    assert [r["seq_id"] for r in src.read_fasta(spark, str(tmp_path / "some")).collect()] == ["g9"]


def test_features_with_their_sequences(spark, tmp_path):
    kind = "seqid string, ann_source string, type string, start int, end int, score double, strand string, phase int, attrs string"
    made = spark.createDataFrame([("c", "x", "gene", 0, 4, None, "+", None, "ID=g")], kind)
    src.write_gff(made, str(tmp_path / "g"), spark.createDataFrame([("c", "ACGT")], "seq_id string, seq string"))
    (tmp_path / "one.gff").write_text("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "g")).collect()) + "\n")
    assert src.read_gff(spark, str(tmp_path / "one.gff")).collect() == made.collect()
    assert [tuple(r) for r in src.read_gff_fasta(spark, str(tmp_path / "one.gff")).collect()] == [("c", "ACGT", 4)]


def test_deep_and_circular_features(spark):
    rows = [(f"n{i}", [f"n{i - 1}"], "x") for i in range(1, 26)] + [("a", ["b"], "x"), ("b", ["a"], "y")]
    features = spark.createDataFrame(rows, "id string, parents array<string>, type string")
    roots = spark.createDataFrame([("n0",), ("a",)], "id string")
    found = {(r["root"], r["id"]): r["level"] for r in ft.closure(features, roots).collect()}
    assert found == {("n0", f"n{i}"): i for i in range(26)} | {("a", "a"): 0, ("a", "b"): 1}
    assert {r["id"] for r in ft.closure(features, roots, ["y"]).collect()} == {"b"}


def test_genetic_codes(spark):
    assert sq.genetic_code(1) == sq.STANDARD_CODE and len(sq.genetic_code(3)) == 64
    got = spark.createDataFrame([("CTTATATGA",)], "s string").select(sq.translated(F.col("s")).alias("a"), sq.translated(F.col("s"), sq.genetic_code(3)).alias("b")).first()
    assert tuple(got) == ("LI*", "TMW")
    with pytest.raises(ValueError, match="7"):
        sq.genetic_code(7)


def test_long_molecules_are_cut_into_pieces(spark, monkeypatch):
    import random
    import re

    monkeypatch.setattr(sq, "PIECE", 7)
    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(300))
    turned = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    found = sq.guides(spark.createDataFrame([("t", seq)], "target_id string, seq string"), Pam.parse("NGG", 9)).collect()
    plain = [(s[m.start() : m.start() + 9], m.start() if strand == "+" else 300 - m.start() - 9, strand) for s, strand in ((seq, "+"), (turned, "-")) for m in re.finditer("(?=.{9}[ACGT]GG)", s)]
    assert sorted((r["grna"], r["start"], r["strand"]) for r in found) == sorted(plain)


def test_masked_genes_need_a_priority(spark):
    kind = "gene string, cluster string"
    one, two = spark.createDataFrame([("a", None), (None, "k")], kind), spark.createDataFrame([("b", None)], kind)
    genes, clusters = spark.createDataFrame([("a",)], "gene string"), spark.createDataFrame([("k", "b")], "cluster string, gene string")
    with pytest.raises(ValueError, match="priority"):
        rec.mask_gene_sets(one, two, genes, clusters)
    both = spark.createDataFrame([(".", None), ("-", None)], kind)
    with pytest.raises(ValueError, match="exclude"):
        rec.mask_gene_sets(both, two, genes, clusters, "mask")
    assert sorted(map(tuple, rec.mask_gene_sets(one, two, genes, clusters, "unmask").collect())) == [("mask", "a"), ("unmask", "b")]
    assert rec.numbered_sources(["x.fa", "y.fa", "x.fa"], "query") == [("query_001", "x.fa"), ("query_002", "y.fa")]


PANEL = [("a", [1, 2, 3]), ("b", [4, 5]), ("c", [1, 2]), ("d", [3, 4, 5]), ("e", [5]), ("f", [1, 4])]


def test_searches_find_covers(spark):
    from itertools import combinations

    groups = spark.createDataFrame(PANEL, "cg string, targets array<int>")
    sets, universe = {k: set(v) for k, v in PANEL}, {1, 2, 3, 4, 5}
    covers = lambda c: set().union(*(sets[g] for g in c)) == universe
    needed = lambda c: all(not covers([g for g in c if g != x]) for x in c)
    found = {}
    for r in cvs.limited_optimal(groups, 3, 1.0).collect():
        found.setdefault(r["solution"], set()).add(r["cg"])
    assert {frozenset(c) for c in found.values()} == {frozenset(c) for k in (1, 2, 3) for c in combinations(sets, k) if covers(c) and needed(c)}
    listed = {}
    for r in cvs.enumerated_covers(groups, 20).collect():
        listed.setdefault(r["solution"], []).append(r["cg"])
    weights = [sum(len(sets[g]) for g in listed[i]) for i in sorted(listed)]
    assert all(covers(c) for c in listed.values()) and weights[0] == 5 and len({tuple(sorted(c)) for c in listed.values()}) == len(listed)


def test_sets_without_redundancy_share_no_guide(spark):
    rows = [(f"g{cg}{k}", f"t{t}", 10 * k + t, 10 * k + t + 20, "+", 200) for cg, ts in PANEL for t in ts for k in range(2)]
    hits = spark.createDataFrame(rows, "grna string, target_id string, start int, end int, sense string, target_len int")
    sets: dict = {}
    for r in cvs.nonredundant_sets(hits, 3).collect():
        sets.setdefault(r["set_number"], []).append(r["grna"])
    assert len(sets) == 3 and len({g for s in sets.values() for g in s}) == sum(map(len, sets.values()))
    targets = {g: {r[1] for r in rows if r[0] == g} for r in rows for g in [r[0]]}
    assert all(set().union(*(targets[g] for g in s)) == {f"t{i}" for i in range(1, 6)} for s in sets.values())
    assert sorted(sets[1]) in (["ga0", "gb0"], ["gc0", "gd0"])


def test_guides_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    targets = spark.createDataFrame([("t", "ACGTACGTACGTACGTACGTAGGTT" * 2)], "target_id string, seq string")
    targets.write.mode("append").parquet(str(tmp_path / "in"))
    stream = guide_stream(spark.readStream.schema(targets.schema).parquet(str(tmp_path / "in")), Pam.parse("NGG"))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    expected = guide_stream(targets, Pam.parse("NGG"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, expected.collect()))
