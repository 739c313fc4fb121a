from __future__ import annotations

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: documents and columns whose names the operators use inside.
DOCUMENTS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()), StructField("id", StringType()),
    StructField("size", StringType()), StructField("start", StringType()), StructField("part__", StringType()),
    StructField("keys", StringType()), StructField("starts", StringType()), StructField("score", StringType()),
])
PASSAGE = " ".join(f"word{i * 37 % 101}{chr(97 + i % 26)}" for i in range(70))


def edge_texts():
    base = " ".join(f"tok{i * 7919 % 997}" for i in range(300))
    near = base.replace("tok0 ", "other ", 1)
    return [
        None, "", " \t\n", "a", "Ünïcode ẞtraße 日本語 \U0001f600 end", "x" * 3000, "ab " * 5000, base, base, near,
        f"front words {PASSAGE} tail words", f"another start {PASSAGE} another end", "\x00control\x7f", "▁already ▁marked",
        "<s> special </s> <|endoftext|>", "MiXeD case\x0bWORDS here", "mixed CASE words HERE", "İstanbul K ǅ", base + " " + "long " * 60_000,
    ]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, [None, "aa", "bb"][i % 3], [None, "s1", "s2", "s1"][i % 4], None, None, "x", "x", "x", None, "x", "x") for i, t in enumerate(edge_texts())]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
