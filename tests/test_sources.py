"""Readers and writers: small files with known rows, and round trips."""

from __future__ import annotations

from strandline.sources import text as src

GFF = """##gff-version 3
chr1\tx\tgene\t11\t40\t.\t+\t.\tID=g1;Name=a
chr1\tx\tCDS\t11\t20\t1.5\t-\t2\tParent=g1;ID=c1
"""


def lines(spark, path):
    return [r["value"] for r in spark.read.text(path).collect()]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 d > e\nAC\nGT\n>s2\n\n>s1\nTTT\n")
    assert rows(src.read_fasta(spark, str(tmp_path / "a.fa"))) == [("s1", "TTT", 3), ("s2", "", 0)]
    made = spark.createDataFrame([("s", "A" * 130)], "seq_id string, seq string")
    src.write_fasta(made, str(tmp_path / "out"))
    assert lines(spark, str(tmp_path / "out")) == [">s", "A" * 60, "A" * 60, "A" * 10]
    assert rows(src.read_fasta(spark, str(tmp_path / "out"))) == [("s", "A" * 130, 130)]


def test_empty_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("")
    assert rows(src.read_fasta(spark, str(tmp_path / "a.fa"))) == []


def test_fasta_section_of_gff(spark, tmp_path):
    (tmp_path / "a.gff").write_text(GFF + "##FASTA\n>chr1 x\nACG\nT\n>chr2\nGG\n")
    (tmp_path / "b.gff").write_text(GFF)
    assert rows(src.read_gff_fasta(spark, str(tmp_path / "a.gff"))) == [("chr1", "ACGT", 4), ("chr2", "GG", 2)]
    assert rows(src.read_gff_fasta(spark, str(tmp_path / "b.gff"))) == []
    assert src.read_gff(spark, str(tmp_path / "a.gff")).count() == 2


def test_gff_and_bed_hold_the_same_features(spark, tmp_path):
    (tmp_path / "a.gff").write_text(GFF)
    gff = src.read_features(spark, str(tmp_path / "a.gff"))
    expected = sorted(map(repr, map(tuple, gff.collect())))
    src.write_gff(gff, str(tmp_path / "gff"))
    src.write_bed(gff, str(tmp_path / "x.bed"))
    assert sorted(map(repr, map(tuple, src.read_features(spark, str(tmp_path / "gff")).collect()))) == expected
    assert sorted(map(repr, map(tuple, src.read_features(spark, str(tmp_path / "x.bed")).collect()))) == expected
    assert "chr1\t10\t20\tc1\t1.5\t-\tx\tCDS\t2\tParent=g1;ID=c1" in lines(spark, str(tmp_path / "x.bed"))


def test_hits(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("q\ts\t99.0\t10\t0\t0\t1\t10\t30\t21\t1e-5\t50\t0\t10\t10\t10\n")
    r = src.read_hits(spark, str(tmp_path / "h.tsv")).first()
    assert (r["qstart"], r["qend"], r["sstart"], r["send"], r["strand"]) == (0, 10, 20, 30, "-")


def test_map_round_trip(spark, tmp_path):
    kind = "grna_id string, grna string, target_id string, target_len int, sense string, strand string, start int, end int, set string, checks map<string,boolean>"
    made = spark.createDataFrame([("g1", "ACGT", "t1", 90, "+", "-", 4, 8, "1", {"GC": True, "background": None}), ("g2", "AAAA", "t1", 90, "+", "+", 0, 4, "2", {"GC": False, "background": True})], kind)
    src.write_map(made, str(tmp_path / "m"), ["background", "GC"])
    found = {r["grna_id"]: r.asDict() for r in src.read_map(spark, str(tmp_path / "m")).collect()}
    assert found == {r["grna_id"]: r.asDict() for r in made.collect()}


def test_guides_take_given_names(spark, tmp_path):
    guides = spark.createDataFrame([("g1", "ACGT"), ("g2", "AAAA")], "grna_id string, grna string")
    names = spark.createDataFrame([("mine", "acgt")], "seq_id string, seq string")
    src.write_guides(guides, str(tmp_path / "g"), names)
    assert rows(src.read_fasta(spark, str(tmp_path / "g"))) == [("g2", "AAAA", 4), ("mine", "ACGT", 4)]


def test_equivalents_are_in_order(spark, tmp_path):
    groups = spark.createDataFrame([("cg_2", "A", 1), ("cg_1", "C", 2), ("cg_1", "G", 2)], "cg string, grna string, n_targets int")
    positions = spark.createDataFrame([("A", 1.0), ("C", 9.126), ("G", 3.0)], "grna string, pos double")
    guides = spark.createDataFrame([("a", "A"), ("c", "C"), ("g", "G")], "grna_id string, grna string")
    table = src.equivalents(groups, positions, guides)
    src.write_tsv(table, str(tmp_path / "e"))
    assert [tuple(r) for r in table.collect()] == [("cg_1", 2, "g", "G", 3.0), ("cg_1", 2, "c", "C", 9.13), ("cg_2", 1, "a", "A", 1.0)]
    assert src.read_table(spark, str(tmp_path / "e")).columns == ["coverage group", "coverage", "gRNA id", "gRNA sequence", "relative pos"]


def test_mask_report(spark):
    files = spark.createDataFrame([("ref", "r.fa"), ("bg", "b.fa")], "alias string, fname string")
    masked = spark.createDataFrame([("r.fa", "chr1", 4, 9, "t1")], "fname string, molecule string, start int, end int, masked string")
    assert [r["value"] for r in src.mask_report(files, masked).collect()] == ["#alias\tfname", "#bg\tb.fa", "#ref\tr.fa", "source\tmolecule\tstart\tend\tmasked", "ref\tchr1\t4\t9\tt1"]
