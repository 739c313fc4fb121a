"""From raw documents to packed training sequences in five stages.

Each stage works on all documents that its predecessor kept; all but the last return
the columns of ``documents``, so each can be written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.minhash import near_duplicates
from strandline.llm.mixing import WORD, mixed_sources
from strandline.llm.packing import packed_sequences
from strandline.llm.pfp import without_repeats
from strandline.llm.toxicity import fitted_model, toxicity_scores
from strandline.operators.scratch import scratch_of_its_own, stored

#: Bytes from which a repeated passage goes: 50 words of four letters and a space.
PASSAGE_BYTES = 250
TOXIC = 0.7


def free_name(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name in columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches ``TOXIC`` go, all others stay, those without
    text among them.  Each row is judged by itself; columns of any name pass through."""
    model = fitted_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = free_name("score__", docs.columns), free_name("spans__", docs.columns)
    scored = toxicity_scores(docs, model, keep=docs.columns, names=names)
    return scored.where(F.col(names[0]) < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays.  Rows of one id
    are one document and leave one row; rows without an id or without words stay."""
    other = free_name("other__", docs.columns)
    same = F.col("doc_id") == F.col(other)
    gone = near_duplicates(docs, width=5, percent=80).where("not kept").select(F.col("doc_id").alias(other))
    kept = docs.join(gone, same, "left_anti")
    repeated = stored(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias(other)), "repeated")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``PASSAGE_BYTES`` that stand anywhere else are cut out of the texts; no
    document goes, and n_chars follows the text (a null text keeps what it has)."""
    cut = without_repeats(docs, PASSAGE_BYTES)
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a repeat is a row of its own.  Documents
    that the mix does not take, those without words among them, have no row.  Rows of one
    id are told apart by source and size; rows alike in all three may change places."""
    times, ids, nth, many = (free_name(n, docs.columns) for n in ("times__", "id__", "nth__", "many__"))
    taken = mixed_sources(docs, keep_source=True)
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if repeated.isEmpty():
        rows, number, same = docs, F.lit(1), F.col("doc_id") == F.col(ids)
    else:
        place = free_name("place__", docs.columns)
        within = lambda size: F.row_number().over(Window.partitionBy("doc_id").orderBy("source", size))
        rows = docs.withColumn(place, within(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))))
        number, same = within("size"), F.col("doc_id").eqNullSafe(F.col(ids)) & (F.col(place) == F.col(nth))
    taken = taken.withColumn("n", number).where("taken > 0").select(F.col("doc_id").alias(ids), F.col("n").alias(nth), (F.col("taken") / F.col("size")).cast("int").alias(many))
    return rows.join(taken, same).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(many))).alias(times)).drop(times)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return packed_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: No stage can be expressed in SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each one's result is written before the next
    begins, and what it wrote on the way is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch_of_its_own(spark):
            made = stage(spark, docs, sf_dir)
            docs = stored(made, name, lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
