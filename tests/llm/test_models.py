from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import queries
from strandline.llm.langid import language_model, predicted_languages
from strandline.llm.spann import PROBES, REPLICAS, nearest_neighbours, postings, usable
from strandline.llm.toxicity import fitted_curve, fitted_model, forward_backward, likelihood_gradient, toxicity_scores

SF = "/root/testdata/sf0.01"


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def test_languages_of_held_out_documents(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()}
    rows = queries.op8_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    right = []
    for r in rows:
        t = truth[r.doc_id]
        assert r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1
        if not any(map(str.isalpha, t.text or "")):
            assert r.lang_pred == "und"
        elif r.held_out and t.lang:
            right.append(r.lang_pred == t.lang)
    assert np.mean(right) > 0.9


def test_language_edges(edge, empty):
    assert predicted_languages(empty, language_model(empty)).collect() == []
    rows = {r.doc_id: r for r in predicted_languages(edge, language_model(edge)).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == "und" and rows[7].lang_pred in ("aa", "bb")


def test_toxicity_of_held_out_documents(spark):
    SF = "/root/testdata/sf0.1"  # fewer labels tell little
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    pairs = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    toxic, clean = [s for s, y, _ in pairs if y], [s for s, y, _ in pairs if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.95
    assert np.mean([p for _, y, p in pairs if y]) > 0.9 and np.mean([y for _, y, p in pairs if p]) > 0.9
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 and r.held_out == held(r.doc_id, 3, 1) for r in rows)


def test_toxicity_edges(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity_scores(empty, fitted_model(empty, none)).collect() == []
    labels = spark.createDataFrame([(7, 1), (10, 0), (11, 0), (99, 1), (8, None)], "doc_id long, toxic int")
    rows = toxicity_scores(edge, fitted_model(edge, labels)).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)


def test_spans_are_places_in_the_text_itself(spark):
    """Letters that grow when lower-cased, and an id that has both labels."""
    filler = [f"calm{i % 7} words{i % 11}" for i in range(400)]
    rows = [(i, f"{filler[i]} İİİ zzbadword{i % 3} {filler[-i - 1]}" if i % 2 else f"{filler[i]} İİİ and {filler[-i - 1]}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    both = [(i, i % 2) for i in range(400)] + [(i, 0) for i in range(1, 400, 8)]
    labels = spark.createDataFrame(both, "doc_id long, toxic int").repartition(4)
    model = fitted_model(docs, labels)
    again = fitted_model(docs, labels.repartition(3))
    assert model.level == again.level and model.curve == again.curve
    for r in toxicity_scores(docs, model, keep=["doc_id", "text"]).collect():
        found = [r.text[s.start : s.end] for s in r.spans]
        assert found == ([w for w in r.text.split() if w.startswith("zzbad")] if r.doc_id % 2 else [])


def test_marginals_equal_sums_over_all_paths():
    rng = np.random.default_rng(0)
    emit, move = rng.random((4, 2)) + 0.1, rng.random((2, 2)) + 0.1
    docs = [rng.integers(0, 4, n).astype(np.int8) for n in (1, 3, 7, 0)]
    for g, p in zip(docs, forward_backward(docs, emit, move), strict=True):
        n, total, toxic = len(g), 0.0, np.zeros(len(g))
        for k in range(2**n if n else 0):
            path = [(k >> i) & 1 for i in range(n)]
            w = np.prod([emit[x, s] for x, s in zip(g, path, strict=True)]) * np.prod([move[a, b] for a, b in zip(path, path[1:], strict=False)])
            total += w
            toxic += w * np.array(path)
        assert n == 0 or np.allclose(p, toxic / total)


def exact(rows, k=5):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 50 == 0:
            s = (x * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1)))
            s[ids == i] = -9
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_found(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    truth = exact([(r.vec_id, r.embedding) for r in vectors.collect()])
    got: dict = {}
    for r in nearest_neighbours(vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    hits = [len({i for i, _ in truth[q]} & {i for i, _ in got.get(q, [])}) / len(truth[q]) for q in truth]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        scores = dict(truth[q])
        assert all(i not in scores or s == pytest.approx(scores[i], abs=1e-12) for i, s in found)


def test_few_lists_are_read_of_many_vectors(spark):
    """50,000 vectors without any structure: recall, and the share of the table compared."""
    n, dim, every = 50_000, 64, 500
    x = np.random.default_rng(3).normal(size=(n, dim)).astype(np.float32)
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x))})).repartition(8)
    got: dict = {}
    for r in nearest_neighbours(rows, every=every).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q in range(0, n, every):
        near = unit @ unit[q]
        near[q] = -9
        hits.append(len(set(np.argpartition(-near, 5)[:5].tolist()) & got[q]) / 5)
    assert np.mean(hits) >= 0.88  # 0.9 on average, less what 100 queries may vary
    posted, asked = postings(usable(rows, "vec_id", "embedding"), n, dim, every, REPLICAS, PROBES, 4.0, 6.0)
    compared = asked.groupBy("list").count().join(posted.groupBy("list").agg({"id": "count"}), "list").selectExpr("sum(count * `count(id)`) as n").first().n
    assert compared / (n * (n // every)) < 0.1
    assert posted.count() <= REPLICAS * n


def test_repeated_ids_keep_their_least_vector(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [1.0, 0.5])]
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()]
    assert sorted(got) == [(0, 1, 2, 0.894427), (0, 2, 1, 0.0)]


def test_neighbour_edges(spark):
    kind = "vec_id long, embedding array<float>, list int, v string, id int"
    assert nearest_neighbours(spark.createDataFrame([], kind)).collect() == []
    bad = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (50, [0.0, 1.0]), (5, [bad, 1.0]), (6, None), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], kind)
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    alone = spark.createDataFrame([(0, [1.0], 1, "x", 2)], kind)
    assert nearest_neighbours(alone).collect() == []


def test_few_far_and_mixed_vectors(spark):
    """Lists of under five vectors, huge magnitudes, two lengths, clashing names."""
    rng = np.random.default_rng(5)
    far = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(-150, 200)], "x") for i in range(150)]
    short = [(1000 + i, [1.0, float(i)], "x") for i in range(4)]
    rows = spark.createDataFrame([*far, *short, (2000, [0.0, 0.0], "x"), (2001, None, "x"), (2002, [float("nan"), 1.0], "x")], "vec_id long, embedding array<double>, list string")
    got: dict = {}
    for r in nearest_neighbours(rows, every=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for group in (far, short):
        unit = {i: np.array(v) / np.abs(v).max() for i, v, _ in group}
        unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
        for q in (i for i in unit if i % 2 == 0):
            scores = [s for _, s in got[q]]
            assert len(scores) == min(5, len(group) - 1) and scores == sorted(scores, reverse=True)
            assert all(abs(s - float(unit[q] @ unit[i])) < 1e-9 for i, s in got[q])
    assert {*got} == {i for i, *_ in far + short if i % 2 == 0}


def plain_ngrams(text):
    """Buckets of all 1- to 3-grams, one by one; the last ones run into zeros."""
    codes, out = [*map(ord, text.lower()), 0, 0], []
    for order in (1, 2, 3):
        for at in range(len(codes) - 2):
            h = order
            for k, key in zip(range(order), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
                h = ((h ^ codes[at + k]) * key) & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h & 0xFFFF)
    return out


def test_languages_equal_a_plain_naive_bayes(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat", "en"), ("die katze saß", "de"), ("el gato se sentó", "es"), ("a dog ran on", "en"), ("der hund lief", "de"), ("und null", None), ("12 ..", "en"), (None, "de"), ("thé und gato", "es"), ("sat ran", "en")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts: dict = {}
    for i, t, lang in rows:
        if lang and not held(i, 5, 0):
            c = counts.setdefault(lang, dict.fromkeys(range(1 << 16), 0.5))
            for b in plain_ngrams(t or ""):
                c[b] += 1
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    for r in predicted_languages(df, language_model(df)).collect():
        text = rows[r.doc_id][1]
        if not any(map(str.isalpha, text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        like = {lang: sum(np.log(c[b] / total[lang]) for b in plain_ngrams(text)) for lang, c in counts.items()}
        best = max(like, key=like.get)
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 / sum(np.exp(v - like[best]) for v in like.values()), rel=1e-4)


def test_gradient_and_curve_of_the_field():
    rng = np.random.default_rng(2)
    grid, tags = rng.integers(0, 3, (4, 5)), rng.integers(0, 2, (4, 5))
    emission, transition = rng.normal(size=(3, 2)), rng.normal(size=(2, 2))

    def likelihood(e, t):
        out = 0.0
        for g, y in zip(grid.T, tags.T, strict=True):
            score = lambda path: sum(e[x, s] for x, s in zip(g, path, strict=True)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
            out += score(y.tolist()) - np.log(sum(np.exp(score([(k >> i) & 1 for i in range(4)])) for k in range(16)))
        return out

    found = likelihood_gradient(grid, tags, emission, transition)
    for which, table in enumerate((emission, transition)):
        for at in np.ndindex(*table.shape):
            step = np.zeros_like(table)
            step[at] = 1e-5
            up, down = ((emission + s, transition) if which == 0 else (emission, transition + s) for s in (step, -step))
            assert found[which][at] == pytest.approx((likelihood(*up) - likelihood(*down)) / 2e-5, abs=1e-6)
    x = rng.normal(size=400) * 2
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.7 * x - 0.6)))).astype(int)
    a, c = fitted_curve(x, y)
    loss = lambda a, c: -np.log1p(np.exp(np.where(y == 1, -1, 1) * (a * x + c))).sum() - 0.005 * (a * a + c * c)
    assert all(loss(a, c) >= loss(a + u, c + v) for u in (-0.01, 0, 0.01) for v in (-0.01, 0, 0.01))
    assert abs(a - 1.7) < 0.6 and abs(c + 0.6) < 0.5
