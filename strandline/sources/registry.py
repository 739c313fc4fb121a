"""Sequence files registered under aliases, as one relation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.records import numbered_sources
from strandline.sources.text import read_fasta


def registered(spark: SparkSession, files: Mapping[str, str] | Sequence[str], prefix: str = "query") -> DataFrame:
    """(source, molecule, seq): the sequences of FASTA files under their aliases; files
    without one are numbered (``prefix_001`` and on).  A file given several times counts
    once, under its first alias; no files give no rows."""
    pairs = list(files.items()) if isinstance(files, Mapping) else numbered_sources(files, prefix)
    first: dict[str, str] = {}
    for alias, path in pairs:
        first.setdefault(path, alias)
    parts = [read_fasta(spark, path).select(F.lit(alias).alias("source"), F.col("seq_id").alias("molecule"), "seq") for path, alias in first.items()]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "source string, molecule string, seq string"))
