"""The stages of corpus_pipeline.py on small tables, each against a plain version."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from strandline.llm.mixing import source_targets
from tests.llm.brute import WORD, near_components, removed

LABELS = "doc_id long, toxic int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Toxic and clean documents, near copies, repeated passages; the labels of most."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    bad = ["vilest", "wretchful", "scumble"]
    passage = " ".join(f"pass{i:02d}" for i in range(51))
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(8):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        if i % 40 == 2:
            text[10:10] = passage.split()
        rows.append((i, " ".join(text), "aa", f"s{i % 3}", 0))
        labels.append((i, int(toxic)))
    rows += [(1000 + k, rows[1][1] + (f" end{k}" if k else ""), "aa", "s0", 0) for k in range(5)]
    rows += [(2000, None, None, None, None), (2001, "", "aa", "s1", 0), (2002, " \t", "bb", None, 3)]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def table(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_toxic_documents_go_and_clean_ones_stay(spark, corpus):
    docs = table(spark, corpus)
    kept = cp.drop_toxic(spark, docs, corpus)
    assert kept.columns == docs.columns
    assert set(texts(kept)) == {i for i, t in texts(docs).items() if not (t and "vilest" in t or t and "scumble" in t or t and "wretchful" in t)}


def test_one_of_each_group_of_near_copies_stays(spark, corpus):
    docs = table(spark, corpus)
    expected = {i for i, (_, comp) in near_components(texts(docs), 5, 80).items() if comp == i}
    assert set(texts(cp.drop_near_duplicates(spark, docs, corpus))) == expected and not {1000, 1004} & expected


def test_repeated_passages_are_cut(spark, corpus):
    docs = table(spark, corpus).where("doc_id < 1000")
    before, after = texts(docs), texts(cp.cut_repeats(spark, docs, corpus))
    cover = removed(before, cp.PASSAGE_BYTES)
    for i, t in before.items():
        assert after[i].encode() == bytes(b for b, c in zip(t.encode(), cover[i], strict=True) if not c)
    assert sum("pass25" in t for t in before.values()) == 10 and not any("pass25" in t for t in after.values())


def test_sources_come_near_their_targets(spark, corpus):
    docs = table(spark, corpus)
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    sums = Counter()
    for i, n in size.items():
        sums[source[i]] += n
    taken, times = Counter(), Counter(r.doc_id for r in cp.mix_sources(spark, docs, corpus).collect())
    for i, k in times.items():
        taken[source[i]] += k * size[i]
    assert max(times.values()) <= 3
    for s, goal in source_targets(dict(sums), (5, 2, 1)).items():
        assert abs(taken[s] - goal) <= max(3, 0.01 * goal)


def test_run_is_the_stages_one_after_the_other(spark, corpus):
    docs = table(spark, corpus)
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, corpus).collect(), docs.schema)
    expected = Counter(r.doc_id for r in cp.STAGES[-1][1](spark, docs, corpus).collect())
    assert Counter(r.doc_id for r in cp.run(spark, corpus).collect()) == expected and expected


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_awkward_tables(spark, corpus, name, edge, empty):
    """Nulls, empty and long texts, repeated rows, clashing columns, no rows."""
    stage = dict(cp.STAGES)[name]
    clash = edge.withColumns({c: F.lit("x") for c in ("score__", "spans__", "text__", "times__", "number__", "row__", "other__", "id__", "nth__", "many__", "place__")})
    for docs in (clash, clash.unionByName(clash)):
        got = stage(spark, docs, corpus)
        assert name == "packing" or got.columns == docs.columns
        assert got.count() > 0
    assert stage(spark, empty, corpus).collect() == []


def test_repeated_rows_keep_one_and_rows_without_id_stay(spark, corpus):
    docs = table(spark, corpus)
    twice = docs.where("doc_id < 20").unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id = 2000").withColumn("doc_id", F.lit(None).cast("long")))
    got = Counter(r.doc_id for r in cp.drop_near_duplicates(spark, twice, corpus).collect())
    assert got == Counter([*range(20), None])
