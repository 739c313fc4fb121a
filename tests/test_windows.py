"""Windows of long molecules: the rows of a plain scan, in time that grows with the length."""

from __future__ import annotations

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.pam import Pam
from strandline.operators import sequences as sq


def molecule(n, seed=1):
    return "".join(np.random.default_rng(seed).choice(list("ACGT"), n))


def test_windows_of_a_piece_boundary_are_all_there(spark):
    for n in (19, 20, 21, sq.PIECE + 18, sq.PIECE + 19, sq.PIECE + 20, 3 * sq.PIECE + 7):
        s = molecule(n, n)
        rows = sq.windows(spark.createDataFrame([("m", s)], "m string, s string"), ["m"], 20, 4, 3)
        rows = rows.select("at", sq.letters(F.col("part"), F.col("at") - F.col("lo"), F.lit(20)).alias("w"), sq.letters(F.col("part"), F.col("at") - F.col("lo") + 20, F.lit(3)).alias("after")).collect()
        assert sorted(map(tuple, rows)) == [(i, s[i : i + 20], s[i + 20 : i + 23]) for i in range(n - 19)]


def test_letters_beyond_ascii_keep_their_places(spark):
    s = "\u00e9" * 3 + molecule(30) + "\U0001f600" + molecule(25)
    found = sq.exact_occurrences(spark.createDataFrame([(s[5:15],), (s[40:50],)], "query string"), spark.createDataFrame([("m", s)], "molecule string, seq string"), 10)
    expected = {(q, m.start()) for q in (s[5:15], s[40:50]) for m in re.finditer(f"(?={q})", s)}
    assert expected <= {(r["query"], r.start) for r in found.where("strand = '+'").collect()}


def test_work_grows_with_the_length(spark):
    def seconds(millions):
        df = spark.createDataFrame([("m", molecule(millions * 1_000_000))], "target_id string, seq string").repartition(1).cache()
        df.count()
        began = time.time()
        sq.guides(df, Pam.parse("NGG")).agg(F.sum("start")).collect()
        return time.time() - began

    seconds(1)
    assert seconds(8) < 4 * seconds(2) * 2  # a square would cost 16 times as much


def test_masks_of_many_lengths(spark):
    from strandline.operators.search import masked_regions

    s = molecule(3000, 4)
    turn = lambda x: x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    masks = {f"k{n}": s[100 * i : 100 * i + n] for i, n in enumerate((1, 5, 7, 8, 11, 12, 15, 23, 24, 25, 90))} | {"back": turn(s[2000:2060]), "none": "", "absent": "ACGT" * 20}
    rows = masked_regions(spark.createDataFrame(list(masks.items()), "seq_id string, seq string"), spark.createDataFrame([("f", "m", s)], "source string, molecule string, seq string")).collect()
    expected = {(name, m.start(), m.start() + len(q)) for name, q in masks.items() if q for form in (q, turn(q)) for m in re.finditer(f"(?={form})", s)}
    assert len(rows) == len(expected) and {(r.masked, r.start, r.end) for r in rows} == expected


@pytest.mark.parametrize("marked", [True, False])
def test_only_marked_windows_meet_masks_that_all_have_a_mark(spark, marked):
    """Masks as texts, in lower case, twice, turned, equal to their other strand, null, empty and with a U;
    one without a mark where its bases may begin makes all of that length meet all windows."""
    from strandline.operators.search import masked_regions

    s = molecule(1500, 7)
    turn = lambda x: x.translate(str.maketrans("ACGTU", "TGCAA"))[::-1]
    s = s[:700] + "TTTTTTTCTTTTTTTTTTTTTTTTTTTTTTTTTTTT" + "ACGTTGCAACGTTGCAACGTTGCAACGT" + s[700:]
    masks = [("a", s[600:640].lower()), ("a", s[600:640]), ("b", turn(s[1:90])), ("p", "ACGTTGCAACGTTGCAACGTTGCAACGT"), ("u", "U" + s[300:330]), ("n", None), ("e", ""), ("first", s[:30] + s[30:60]), ("last", s[-40:])]
    masks += [] if marked else [("t", "TTTTTTTCTTTTTTTTTTTTTTTTTTTTTTTT")]
    found = masked_regions(spark.createDataFrame(masks, "seq_id string, seq string").repartition(3), spark.createDataFrame([("f", "m", s), ("f", "x", None), ("f", "y", s[:5])], "source string, molecule string, seq string"))
    expected = {(name, m.start(), m.start() + len(q)) for name, q in masks if q for form in (q.upper(), turn(q.upper())) for m in re.finditer(f"(?={form})", s)}
    rows = found.collect()
    assert len(rows) == len(expected) >= 5 and {(r.masked, r.start, r.end) for r in rows} == expected
    assert ("as string) = G)" in found._jdf.queryExecution().executedPlan().toString()) == marked


def test_both_strands_have_one_text(spark):
    texts = ["ACGT", "AACC", "GGTT", "UUCG", "CGAA", "TTCG", "NRYN", "", "A-x", None]
    found = sq.strandless(spark.createDataFrame([(t, t) for t in texts], "s string, t string"), "s").select("t", "either", sq.of_strandless("s").alias("s")).collect()
    assert [r.s for r in found] == [r.t for r in found] == texts[:-1]
    same = {r.t: r.either for r in found}
    assert same["AACC"] == same["GGTT"] and same["UUCG"] == same["CGAA"] == same["TTCG"] and same["ACGT"] == "ACGT"


@pytest.mark.parametrize("name", ["design_guides", "mask_identical"])
def test_masks_are_derived_once(spark, sf_dir, name):
    from strandline.plans import catalog

    assert "part.parquet" not in catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
