from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import packing, webp
from strandline.llm.mixing import bounded_knapsack, fit_lengths, mixed_sources, source_targets
from strandline.llm.packing import packed_sequences, plan_bins
from strandline.llm.shards import balanced_shards
from strandline.llm.tokens_bpe import token_counts, vocabulary
from strandline.llm.webp import BitWriter, decode, encode, media_digest, write_code
from tests.llm.brute import WORD, crc

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@lru_cache
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abe ▁  <s>é\n")), max_size=60))
def test_counts_equal_the_library_on_any_text(text):
    assert vocabulary(PIECES).count(text) == len(library().encode(text))


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_token_counts(request, table):
    df = request.getfixturevalue(table)
    texts = {r[0]: r[1] or "" for r in df.select("doc_id", "text").collect()}
    rows = token_counts(df, PIECES).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library().encode(texts[r.doc_id], num_threads=1))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_shards_are_whole_contiguous_and_near_equal(request, table):
    df = request.getfixturevalue(table)
    texts = {r[0]: r[1] for r in df.select("doc_id", "text").collect()}
    rows = balanced_shards(df, 24).collect()
    assert Counter(r.doc_id for r in rows) == Counter(texts.keys())
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len((texts[r.doc_id] or "").encode()) + 8, crc(texts[r.doc_id]), "bytes")
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, most = sum(size.values()) / 24, max(r.size for r in rows)
    assert all(abs(size[s] - mean) <= most for s in range(24))


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_packing_keeps_every_id_once_with_little_padding(request, table):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(table)
    tokenizer = Tokenizer.from_file(WORDS)
    texts = {r[0]: r[1] or "" for r in df.select("doc_id", "text").collect()}
    rows = packed_sequences(df, WORDS).collect()
    of, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert set(of) == set(texts)
    for i, pieces in of.items():
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    if table == "docs":
        assert len(seq) <= 1.03 * total / 2048 + 1


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_ids_equal_the_library_on_any_text(text):
    v = packing.word_ids(WORDS)
    assert v.encode([text]) == [v.whole(text)]


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plans_take_the_demand_exactly(counts):
    demand = np.zeros(32, np.int64)
    for s, n in counts.items():
        demand[s - 1] = n
    got = np.zeros(32, np.int64)
    for pattern, uses in plan_bins(demand, 32):
        assert (pattern * np.arange(1, 33)).sum() <= 32
        got += uses * pattern
    assert (got == demand).all()


def test_empty_tables(empty):
    for df in (token_counts(empty, PIECES), balanced_shards(empty, 24), packed_sequences(empty, WORDS), media_digest(empty), mixed_sources(empty)):
        assert df.collect() == []


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_media_come_back_whole(request, table):
    df = request.getfixturevalue(table)
    texts = {r[0]: (r[1] or "").encode() for r in df.select("doc_id", "text").collect()}
    rows = media_digest(df, with_media=True).collect()
    assert len(rows) == len(texts)
    by_text = defaultdict(set)
    for r in rows:
        data = texts[r.doc_id]
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        by_text[data].add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=600), st.integers(1, 40))
def test_encoded_samples_are_decoded(data, width):
    samples = np.frombuffer(data + bytes(-len(data) % width), np.uint8).reshape(-1, width)
    assert (((decode(encode(samples)) >> np.uint32(8)) & np.uint32(255)) == samples).all()


def _file(w: BitWriter) -> bytes:
    raw = np.packbits(w.bits(), bitorder="little").tobytes()
    padded = raw + b"\0" * (len(raw) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(raw).to_bytes(4, "little") + padded


def _header(width, height):
    w = BitWriter()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(1, 1)
    w.write(0, 3)
    return w


def _one(w, symbol, size=256):
    write_code(w, np.eye(1, size, symbol, dtype=np.int64)[0])


def test_decoder_inverts_subtract_green():
    w = _header(2, 2)
    w.write(1, 1), w.write(2, 2), w.write(0, 1), w.write(0, 1), w.write(0, 1)
    for s in (7, 250, 10, 255):  # green, red, blue, alpha: one symbol each
        _one(w, s, 280 if s == 7 else 256)
    _one(w, 0, 40)
    assert (decode(_file(w)) == ((255 << 24) | (((250 + 7) & 255) << 16) | (7 << 8) | 17)).all()


def test_decoder_reads_back_references_and_the_colour_cache():
    w = _header(8, 1)
    w.write(0, 1), w.write(1, 1), w.write(1, 4), w.write(0, 1)  # a cache of two colours, one group
    lengths = np.zeros(282, np.int64)
    colour = 0xFF050904
    slot = 280 + ((0x1E35A7BD * colour & 0xFFFFFFFF) >> 31)
    for s in (9, 256 + 2, slot):  # a literal, a run of 3, the cached colour
        lengths[s] = 2
    lengths[20] = 2
    write_code(w, lengths)
    for s in (5, 4, 255):
        _one(w, s)
    _one(w, 1, 40)  # distance code 2: the pixel to the left
    codes = {s: c for s, (c, _) in webp.canonical_codes(lengths).items()}
    for s in (9, 258, slot, 258):
        w.write(codes[s], 2)
    assert decode(_file(w)).tolist() == [[colour] * 8]


def test_decoder_inverts_a_palette():
    w = _header(4, 1)
    w.write(1, 1), w.write(3, 2), w.write(1, 8)  # two colours: eight pixels a byte
    w.write(0, 1)
    for s, n in ((3, 280), (2, 256), (1, 256), (255, 256), (0, 40)):
        _one(w, s, n)  # both deltas 0xFF020301: the second colour is their sum by channel
    w.write(0, 1), w.write(0, 1), w.write(0, 1)
    for s, n in ((0b1010, 280), (0, 256), (0, 256), (0, 256), (0, 40)):
        _one(w, s, n)
    first, second = 0xFF020301, 0xFE040602
    assert decode(_file(w)).tolist() == [[first, second, first, second]]


@pytest.mark.parametrize("table", ["docs", "edge"])
def test_mixing_comes_near_the_targets(request, table):
    df = request.getfixturevalue(table)
    of = {r[0]: (r[1], len(WORD.findall(r[2] or ""))) for r in df.select("doc_id", "source", "text").collect()}
    sizes = Counter()
    for s, n in of.values():
        sizes[s] += n
    targets = source_targets(dict(sizes), (5, 2, 1))
    rows, taken = mixed_sources(df).collect(), Counter()
    assert Counter(r.doc_id for r in rows) == Counter(of.keys())
    for r in rows:
        s, n = of[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s]) and r.target == pytest.approx(targets[s])
        assert r.taken <= 3 * n and (r.taken % n == 0 if n else r.taken == 0)
        taken[s] += r.taken
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1 or all(abs(targets[s] - 3 * sizes[s]) < 1 for s in sizes)
    if table == "docs":
        for s in sizes:  # ten documents each: the best sum that whole documents can have
            passes = min(3, int(targets[s] // sizes[s]))
            held = 1 if 0 < passes < 3 else 0
            reach = {(passes - held) * sizes[s]}
            for n in [n for x, n in of.values() if x == s and n]:
                reach = {r + k * n for r in reach for k in range(2 + held if passes < 3 else 1)}
            best = max(r for r in reach if r <= round(targets[s]))
            assert best - 0.001 * targets[s] <= taken[s] <= best
    assert sorted(map(tuple, mixed_sources(df).collect())) == sorted(map(tuple, rows))


def test_targets_stop_at_three_times_a_source():
    got = source_targets({"a": 10, "b": 1000, "c": 1000, None: 0}, (5, 2, 1))
    assert got["a"] == 30 and got[None] == 0 and sum(got.values()) == pytest.approx(2010)
    assert got["b"] / got["c"] == pytest.approx(2)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(0, 4), max_size=5), st.integers(0, 60))
def test_knapsack_finds_the_best_sum(counts, budget):
    reach = {0}
    for length, n in counts.items():
        reach = {r + k * length for r in reach for k in range(n + 1)}
    take = bounded_knapsack(counts, budget)
    assert sum(k * n for k, n in take.items()) == max(r for r in reach if r <= budget)
    assert all(n <= counts[k] for k, n in take.items())


@pytest.mark.parametrize(("other", "share"), [(36_400, 0.9), (64_400, 1.043), (142_800, 1.443)])
def test_mixing_takes_long_documents_with_the_rest(spark, other, share):
    sizes = [("a", 40_000)] + [("a", 1_000)] * 100 + [("b", 100)] * (other // 100)
    df = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes)], "doc_id long, text string, source string")
    target = (140_000 + other) * 5 / 7  # 126,000 of the first words, all of them and 6,000, or 62,000 more
    assert target / 140_000 == pytest.approx(share, abs=0.001)
    taken = sum(r.taken for r in mixed_sources(df).where("source = 'a'").collect())
    assert 0 <= round(target) - taken < 1_000


@pytest.mark.parametrize(
    ("counts", "budget", "best"),
    [
        ({60_000: 1, 50_000: 2}, 100_000, 100_000), ({40_000: 3}, 90_000, 80_000), ({30_000: 40, 20_001: 40, 17_000: 40, 1: 10_000}, 1_000_000, 1_000_000),
        ({3_000_000: 2, 2_000_000: 1, 7: 1000}, 5_000_703, 5_000_700), ({9_000_001: 5, 5: 1_000_000, 1: 4}, 12_000_003, 12_000_003), ({10**9: 1, 3: 10**9}, 2 * 10**9, 2 * 10**9 - 1),
    ],
)
def test_lengths_beyond_the_window_are_fitted(counts, budget, best):
    take = fit_lengths(counts, budget)
    assert all(0 <= n <= counts[k] for k, n in take.items())
    assert sum(k * n for k, n in take.items()) == best
