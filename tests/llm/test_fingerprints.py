"""Order MinHash: against a plain version, next documents of awkward tables, and its plan."""

from __future__ import annotations

import hashlib
import struct

import pytest
import xxhash

from strandline.llm import order_minhash as omh
from strandline.llm.queries import QUERIES
from tests.llm.conftest import DOCUMENTS


def spark_hash(seed, value):
    data = value.encode() if isinstance(value, str) else value
    return xxhash.xxh64_intdigest(data, seed=seed % (1 << 64))


def plain(text):
    data = text.encode()
    n, m = len(data), 1 << 64
    kmers = [data[i : i + omh.KMER] for i in range(n - omh.KMER + 1)] if n >= omh.KMER else [data] if n else []
    seen, ranked = {}, []
    for place, kmer in enumerate(kmers, 1):
        key = (spark_hash(42, kmer) << omh.PLACE) % m >> omh.PLACE
        seen[key] = seen.get(key, 0) + 1
        rank = key
        if seen[key] > 1:
            rank = (spark_hash(spark_hash(42, struct.pack("<q", key)), struct.pack("<i", seen[key])) << omh.PLACE) % m >> omh.PLACE
        ranked.append((rank >> 27, rank, place))
    out = []
    for b in range(64):
        least = sorted(x for x in ranked if x[0] == b)[: omh.LEAST]
        if least:
            seed = 42
            for _, rank, _ in sorted(least, key=lambda x: x[2]):
                seed = spark_hash(seed, struct.pack("<Q", (rank << omh.PLACE) % m))
            out.append((b << omh.PART) | seed % (1 << omh.PART))
    return out


def like(a, b):
    either = {x >> omh.PART for x in a} | {x >> omh.PART for x in b}
    return len(set(a) & set(b)) / len(either) if either else 1.0


def text_of(f):  # bins in the order of signed numbers
    return "".join(f"{x:06x}" for x in sorted(f, key=lambda x: (x >> omh.PART) ^ 32))


def rows_of(rows):
    """Rows from (id, text) in their order: edited text, fingerprints, likeness."""
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out, made = [], {t: plain(t) for _, t in rows}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        f, e = made[t], plain(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(f), text_of(e), round(like(f, e), 9), round(like(f, made[after]), 9)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in omh.edited_fingerprints(df).collect()), key=repr)


def test_equals_a_plain_version(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(omh, "RANGE_ROWS", 16)
    assert found(docs) == rows_of(texts.items())


def test_edge_tables(spark, edge, empty, monkeypatch):
    monkeypatch.setattr(omh, "RANGE_ROWS", 3)
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert found(edge) == rows_of(rows)
    assert found(empty) == []
    again = edge.unionByName(edge).unionByName(edge.where("doc_id in (3, 7, 8, 9)").selectExpr("cast(null as bigint) as doc_id", *[f"`{c}`" for c in edge.columns[1:]]))
    assert found(again) == rows_of([(r.doc_id, r.text) for r in again.collect()])
    one = spark.createDataFrame([(7, "only one text here", *[None] * 10)], DOCUMENTS)
    assert found(one) == rows_of([(7, "only one text here")])
    lost = edge.where("doc_id in (0, 1, 9)").selectExpr("cast(null as bigint) as doc_id", *[f"`{c}`" for c in edge.columns[1:]])
    assert found(lost) == rows_of([(None, r.text) for r in lost.collect()])


@pytest.mark.parametrize("text", ["x" * 3000, "ab " * 2000, "日本語テキスト" * 50])
def test_repeats_are_numbered(spark, text):
    df = omh.fingerprints(spark.createDataFrame([(text,)], "t string"), {"t": "f"})
    assert sorted(df.first().f) == plain(text)


def test_order_counts(spark):
    words = [f"word{i * 7919 % 997}" for i in range(400)]
    moved = words[200:] + words[:200]
    mixed = sorted(words)
    rows = omh.fingerprints(spark.createDataFrame([(" ".join(w),) for w in (words, moved, mixed)], "t string"), {"t": "f"}).collect()
    a, b, c = (r.f for r in rows)
    assert 0.3 < like(a, b) < 0.8 and like(a, c) < like(a, b)


def test_main_path_is_native(spark, sf_dir):
    plan = QUERIES["op12_fingerprints"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_edited_texts_are_nearer_than_next_ones(spark, sf_dir):
    rows = QUERIES["op12_fingerprints"](spark, sf_dir).where("n_chars > 200").collect()
    nearer = sum(r.near_edited > r.near_next for r in rows)
    assert nearer >= 0.95 * len(rows)
    assert 0.3 < sum(r.near_edited for r in rows) / len(rows) < 0.7
