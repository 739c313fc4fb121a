from __future__ import annotations

import random

import pytest

from strandline.llm.components import components
from strandline.llm.minhash import blocked, near_duplicates
from strandline.llm.pfp import parse_rows, removal_digest, without_repeats
from tests.llm.brute import near_components, removal_row, removed


@pytest.mark.parametrize("table", ["docs", "edge"])
@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_equal_those_of_all_pairs(request, table, width, percent):
    df = request.getfixturevalue(table)
    texts = {r[0]: r[1] for r in df.select("doc_id", "text").collect()}
    expected = near_components(texts, width, percent)
    rows = near_duplicates(df, width, percent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id]
        assert r.kept == (r.component_id == r.doc_id)


def test_chains_and_large_groups_are_joined(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(60):  # each differs from the next by one word, the ends share little
        words[i * 3] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, "the same text again and again") for i in range(300)]
    rows += [(500 + i, f"{' '.join(f'c{j}' for j in range(60))} end{i}") for i in range(80)]
    texts = dict(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 85).collect()
    expected = near_components(texts, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected


def test_a_group_that_fills_many_buckets_is_compared_with_others_once(spark):
    rows = [(b, i, 1) for b in range(40) for i in range(1, 301)] + [(b, 1000 + b % 3, 1000 + b % 3) for b in range(40)] + [(0, 2000, 2000)]
    placed = spark.createDataFrame(rows, "bucket long, id long, comp long")
    blocks, mixed = blocked(placed, placed.selectExpr("id", "10L as n", "binary('') as sketch").distinct())
    got = blocks.collect()
    assert len(got) == 300 + 4 + 2 and mixed.count() == 40
    by = {}
    for r in got:
        by.setdefault((r.bucket, r.piece, r.turn), []).append(r)
    met = {(q.id, c.id) for block in by.values() for q in block if q.asks for c in block if c.left and c.comp != q.comp}
    assert met >= {(q, c) for q in (1000, 1001, 1002, 2000) for c in range(1, 301)} | {(1000, 2000), (2000, 1000)}


def test_components_of_a_path_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(300, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in range(200, 260)) and 300 not in got


@pytest.mark.parametrize("table", ["docs", "edge"])
@pytest.mark.parametrize("window", [50, 400])
def test_removed_bytes_equal_those_of_all_windows(request, table, window):
    df = request.getfixturevalue(table)
    texts = {r[0]: r[1] for r in df.select("doc_id", "text").collect()}
    assert table == "docs" or max(len(t or "") for t in texts.values()) > 300_000
    cover = removed(texts, window)
    rows = removal_digest(df, window).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == removal_row(texts[r.doc_id], cover[r.doc_id])
        left = bytes(b for b, c in zip((texts[r.doc_id] or "").encode(), cover[r.doc_id], strict=True) if not c)
        assert (r.kept_bytes, r.text, r.n_chars) == (len(left), left.decode(errors="ignore"), len(r.text))


def test_repeated_rows_repeat_each_other(spark):
    kind = "doc_id long, text string"
    a, b = "".join(chr(97 + i * i % 23) for i in range(300)), "".join(chr(97 + i * 7 % 26) for i in range(300))
    rows = [(1, a), (1, a), (None, b), (None, b), (2, a[:120] + b[100:]), (1, "short")]
    got = sorted((r.n_bytes, r.n_removed) for r in removal_digest(spark.createDataFrame(rows, kind), 100).collect())
    assert got == [(5, 0), (300, 300), (300, 300), (300, 300), (300, 300), (320, 320)]


@pytest.mark.parametrize("seed", range(3))
def test_repetitive_text(spark, seed):
    rng = random.Random(seed)
    unit = "".join(rng.choice("abc") for _ in range(17))
    rows = [(0, unit * 40), (1, "q" * 700 + unit * 9), (2, "".join(rng.choice("ab") for _ in range(900))), (3, "q" * 401), (4, "é" * 300 + "z" + "é" * 250)]
    texts = dict(rows)
    cover = removed(texts, 100)
    for r in removal_digest(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == removal_row(texts[r.doc_id], cover[r.doc_id])


def test_every_window_belongs_to_one_row():
    rng = random.Random(1)
    for data in (bytes(rng.randrange(256) for _ in range(3000)), b"a" * 1000, b"ab" * 400 + bytes(rng.randrange(97, 100) for _ in range(800))):
        at = [p for _, s, t in parse_rows(data, 100) for p in range(s, t + 1)]
        assert sorted(at) == list(range(len(data) - 99))


def test_cutting_keeps_columns_and_whole_characters(edge):
    cut = without_repeats(edge, 100)
    assert cut.columns == edge.columns and cut.count() == edge.count()
    assert all(r.text is None or "�" not in r.text for r in cut.collect())


def test_empty_tables(empty):
    assert near_duplicates(empty).collect() == [] and removal_digest(empty).collect() == []
