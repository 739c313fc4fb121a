"""Tables derived from small files are never brought to the driver to be broadcast."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.operators import joins
from strandline.operators.features import with_attribute_map, with_ids
from strandline.operators.joins import ROWS, SORTED_ROWS, dealt, spread
from strandline.operators.sequences import feature_sequences
from strandline.plans import catalog

NAMES = ["aln_target_join", "background_check", "effective_feature_ranges", "feature_check", "find_identical", "flank", "homologue_hsp", "mask_identical", "domain_ranges", "background_gapped"]


@pytest.mark.parametrize("name", NAMES)
def test_no_derived_table_is_broadcast(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_rows_are_dealt_over_more_tasks_as_they_grow(spark):
    few, many = spread(spark.range(100), "id"), spread(spark.range(5 * ROWS), "id")
    assert few.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 6
    assert many.count() == 5 * ROWS


@pytest.mark.parametrize("name", ["attr_lookup", "attr_standardise"])
def test_attribute_maps_shuffle_nothing(spark, sf_dir, name):
    assert "Exchange" not in catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_attribute_maps(spark):
    texts = ["Name=a;Parent=b,c; Parent =d;note;x=1=2", "note", None]
    found = with_attribute_map(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, attrs string")).orderBy("k").collect()
    assert [r["attributes"] for r in found] == [{"Name": ["a"], "Parent": ["b", "c", "d"], "x": ["1=2"]}, {}, None]


def test_attribute_maps_of_odd_texts(spark):
    """Against a plain parser: no text, empty text, items without ``=``, names that repeat, in order."""

    def plain(text):
        out = {}
        for kv in (text or "").split(";"):
            if "=" in kv:
                name, values = kv.split("=", 1)
                out.setdefault(name.strip(" "), []).extend(values.split(","))
        return None if text is None else list(out.items())

    texts = [None, "", ";", "=", "a=", "=b", "x", "x;y=1=2,3;;", "a=1;a=2,3;b=4", "b=1;a=2; b =,;c=;a=3", "A=1;a=2", "=1;=2", "\u00e9=\u00fc,\u00df;\u00e9=1"]
    found = with_attribute_map(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts])], "k int, attrs string")).orderBy("k").select(F.map_entries("attributes").alias("x")).collect()
    assert [None if r["x"] is None else [(e["key"], e["value"]) for e in r["x"]] for r in found] == [plain(t) for t in [*texts, *texts]]


def test_attributes_are_entries_as_they_stand_unless_a_name_repeats(spark, sf_dir):
    """Names are looked up among the items of their text only in the branch for names that repeat."""
    for name in ("features_by_id", "attr_lookup"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "map_from_entries" in plan and "stringsplitsql" not in plan, name


def test_features_of_ids_keep_null_and_repeated_rows(spark):
    features = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (3, "b"), (4, ""), (5, "c")], "line_no int, id string")
    ids = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("",)], "id string")
    assert sorted((r["line_no"], r["id"]) for r in with_ids(features, ids).collect()) == [(1, "a"), (3, "b"), (3, "b"), (4, "")]


def test_large_tables_are_sorted_in_more_tasks(spark):
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt(spark.range(100), ["id"], 3 * usual * SORTED_ROWS).rdd.getNumPartitions() == 3 * usual + 1
    few = spark.range(100)
    assert dealt(few, ["id"], SORTED_ROWS) is few


def test_large_tables_of_ranges_are_dealt_by_their_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(joins, "SORTED_ROWS", 100)
    for name in ("ranges_union", "extract_ranges", "reference_seq", "merged_seqs"):
        tasks = catalog.sub.table(spark, sf_dir, "lineitem").count() // 100 + 1
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert f", {tasks}), REPARTITION_BY_NUM" in plan, name


def test_a_feature_on_two_molecules_is_one_sequence(spark):
    parts = spark.createDataFrame([("g", "a", "+", 4, 6), ("g", "b", "+", 0, 2), ("g", "a", "+", 5, 8), ("h", "a", "-", 0, 2)], "gene string, target_id string, strand string, start int, end int")
    molecules = spark.createDataFrame([("a", "AACCGGTTAA"), ("b", "CATCAT")], "target_id string, seq string")
    found = feature_sequences(parts, molecules, ["gene"]).collect()
    assert sorted(map(tuple, found)) == [("g", "1-2,5-8", "CAGGTT"), ("h", "1-2", "TT")]
