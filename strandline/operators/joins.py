"""Joins of tables that are larger than their plan tells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Rows of a table, at most, from which one task derives others.
ROWS = 2_048
#: Rows of a plain table, at most, that one task sorts or groups.
SORTED_ROWS = 500_000


def merged_in_joins(df: DataFrame) -> DataFrame:
    """``df`` for joins by sorting.  The size of a plan counts neither the rows that an array is
    taken apart into nor the length of derived text, so Spark would take such a table for a small
    one and bring it whole to the driver to broadcast it."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over tasks of about ``ROWS`` rows: a small file that much is derived
    from is one split, which one task would work through alone."""
    return df.repartition(df.count() // ROWS + 1, *keys)


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as a table of ``rows`` rows needs for a task to
    sort or group no more than about ``SORTED_ROWS`` of them.  Where the usual number of
    partitions is enough, ``df`` as it is."""
    tasks = rows // SORTED_ROWS + 1
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
