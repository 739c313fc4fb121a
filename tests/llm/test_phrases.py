"""Collocations: against a plain version, the SQL, awkward tables and small bitmaps."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from strandline.llm import phrases as ph
from strandline.llm.queries import ORACLES, QUERIES
from tests.conftest import duck_rows, rows_of
from tests.llm.conftest import DOCUMENTS

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, first=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: c for p, c in counts.items() if c >= least}
        kept = []
        for p, a in found.items():
            if len(p) < 2:
                continue
            longer = [c for q, c in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * c >= 80 * a for c in longer):
                continue
            score, k, l, r = min((2_000_000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r[c] for c in COLUMNS) for r in ph.collocations(df, **more).collect())


def test_equals_the_sql(spark, sf_dir):
    got = QUERIES["op13_phrases"](spark, sf_dir)
    columns, expected = duck_rows(ORACLES["op13_phrases"], sf_dir)
    assert sorted(got.columns) == columns and expected
    assert rows_of(got.columns, got.collect()) == expected


@pytest.mark.parametrize("bits", [12, 20])
def test_equals_a_plain_version_with_few_and_many_buckets(spark, docs, monkeypatch, bits):
    monkeypatch.setattr(ph, "LEAST_BITS", bits)
    monkeypatch.setattr(ph, "MOST_BITS", bits)
    monkeypatch.setattr(ph, "BLOCK_BYTES", 20_000)
    some = docs.where("doc_id < 60")
    assert found(some, least=6, first=300) == plain([(r.lang, r.text) for r in some.collect()], 6, 300)


def test_edge_tables(spark, edge, empty):
    assert found(empty) == []
    rows = [(r.lang, r.text) for r in sorted(edge.collect(), key=lambda r: r.doc_id)]
    assert found(edge, least=2) == plain(rows, 2)
    assert found(edge.unionByName(edge), least=4) == plain(rows + rows, 4)
    silent = edge.where("doc_id < 3")
    assert found(silent, least=1) == plain(rows[:3], 1) == []


def test_pieces_ties_and_covered_phrases(spark):
    text = "A b c d. a b c d, a b\tC  d; x y! x y? x y z\n\x0bé É é É"
    rows = [(1, text * 3, None, *[None] * 9), (2, text, "und", *[None] * 9), (3, "x y z", "zz", *[None] * 9)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    got = found(df, least=1)
    assert got == plain([(r[2], r[1]) for r in rows], 1)
    phrases = {r[2] for r in got}
    assert "a b c d" in phrases and "a b" not in phrases and "x y" in phrases


def test_words_are_hashed_alike_everywhere_and_texts_made_in_bulk():
    long = b"x" * 200
    a, b = ph.words_of([b"one two three " + long], [0]), ph.words_of([b"three", "zé ".encode() + long + b"y two,two"], [1, 2])
    of = lambda w: dict(zip(w.names.to_pylist(), w.hashes.tolist(), strict=True))
    both = of(a).keys() & of(b).keys()
    assert both == {b"two", b"three"} and all(of(a)[w] == of(b)[w] for w in both)
    assert len({*of(a).values(), *of(b).values()}) == len(of(a).keys() | of(b).keys()) == 6
    assert ph.word_hashes(a.names[2:]).tolist() == a.hashes[2:].tolist()
    texts = a.text(a.grams(2), 2)
    assert texts.type == "string" and texts.to_pylist() == ["one two", "two three", f"three {long.decode()}"]
    place, count = b.distinct(b.grams(1), 1)
    assert sorted(zip(b.text(place, 1).to_pylist(), count.tolist(), strict=True))[1:3] == [("two", 2), (f"{long.decode()}y", 1)]
