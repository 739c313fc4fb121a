"""Long FASTA records read by several tasks, and guides of molecules in chunks."""

from __future__ import annotations

import random

import pytest

from strandline.functions.pam import Pam
from strandline.operators import chunks as ch
from strandline.operators import sequences as sq
from strandline.sources.fasta import read_fasta_chunks
from tests.test_homology import dna


def wrapped(s, n):
    return "\n".join(s[i : i + n] for i in range(0, len(s), n))


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)
    for k, v in old.items():
        spark.conf.set(k, v)


def test_records_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    long, other, again = dna(rng, 50_000), dna(rng, 700), dna(rng, 4_000)
    (tmp_path / "a.fa").write_text(f"junk\n>long some words\n{wrapped(long, 60)}\n\n>other\n{wrapped(other, 71)}\n>twice\nACGT\n>empty\n>twice\n{wrapped(again, 50)}\n")
    (tmp_path / "b.fa").write_text(f">other x\n{wrapped(other[:50], 10)}\n>lower\nacgtn\n")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    rows = read_fasta_chunks(spark, str(tmp_path), 1000).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.molecule, r.chunk)):
        assert r.base == r.chunk * 1000 == len(found.get(r.molecule, ""))
        found[r.molecule] = found.get(r.molecule, "") + r.part
    assert found == {"long": long, "other": other[:50], "twice": again, "lower": "acgtn"}


@pytest.mark.parametrize("pam", ["NGG", "TTTV."])
def test_guides_of_chunks_equal_those_of_molecules(spark, pam):
    rng = random.Random(3)
    df = spark.createDataFrame([(f"m{i}", dna(rng, n)) for i, n in enumerate((0, 10, 64, 65, 700, 1500))], "molecule string, seq string")
    p = Pam.parse(pam)
    expected = sorted(map(tuple, sq.guides(df, p, ("molecule",)).collect()))
    assert sorted(map(tuple, ch.chunk_guides(ch.chunked(df, size=64), p, 64).collect())) == expected != []
