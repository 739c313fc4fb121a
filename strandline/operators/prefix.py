"""Global prefix sums over a range-partitioned order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from strandline.operators.scratch import stored


def global_prefix(df: DataFrame, order: Sequence[str | Column], measures: Sequence[str]) -> DataFrame:
    """Add ``row_before`` and, for each long column m of ``measures``,
    ``m_before``: how many rows, and how much of m, come before a row in ``order``.

    Rows are range-partitioned and sorted, each partition adds up its own rows as
    they stream by, and the totals of the partitions (one row each) give every
    partition's start.  ``order`` should be total; equal rows keep any order.
    A hot leading key is split by the later keys of ``order``.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names = list(df.columns)
    extra = [StructField("part__", IntegerType()), StructField("row_before", LongType())]
    extra += [StructField(f"{m}_before", LongType()) for m in measures]
    schema = StructType(list(df.schema.fields) + extra)

    def local(batches):
        part, rows, sums = TaskContext.get().partitionId(), 0, dict.fromkeys(measures, 0)
        for b in batches:
            n = b.num_rows
            arrays = [b.column(i) for i in range(len(names))]
            arrays += [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n))]
            rows += n
            for m in measures:
                v = b.column(names.index(m)).to_numpy(zero_copy_only=False).astype(np.int64)
                arrays.append(pa.array(np.cumsum(v) - v + sums[m]))
                sums[m] += int(v.sum())
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    rows = stored(ordered.mapInArrow(local, schema), "prefix")
    totals = rows.groupBy("part__").agg(F.count(F.lit(1)).alias("n__"), *[F.sum(m).alias(f"{m}__") for m in measures])
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part__",
        F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("row_start__"),
        *[F.coalesce(F.sum(f"{m}__").over(before), F.lit(0)).alias(f"{m}_start__") for m in measures],
    )  # one row for each partition of the sort
    return rows.join(F.broadcast(starts), "part__").select(
        *names,
        (F.col("row_before") + F.col("row_start__")).alias("row_before"),
        *[(F.col(f"{m}_before") + F.col(f"{m}_start__")).alias(f"{m}_before") for m in measures],
    )


def prefix_within(df: DataFrame, key: str, order: Sequence[str | Column], measures: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns with ``row_before`` and, for each long column m of ``measures``,
    ``m_before``: how many rows of the same ``key`` (a long, not null), and how much of m of
    them, come before a row in ``order``.  Sums wrap at 64 bits.

    A key may hold any share of the rows: they are range-partitioned by key and order, and
    each partition (one summary row each) hands its last key's totals on to the next ones.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).select(*keep)
    before = ["row_before", *[f"{m}_before" for m in measures]]
    longs = [StructField(n, LongType()) for n in before]
    kept = [StructField(f.name, f.dataType) for f in ordered.schema.fields]  # null in summaries
    schema = StructType([*kept, StructField("part__", IntegerType()), StructField("first__", LongType()), *longs])

    def local(batches):
        part, first, last, state = TaskContext.get().partitionId(), None, None, np.zeros(len(before), np.int64)
        types = {}
        for b in batches:
            if not b.num_rows:
                continue
            types = {f.name: f.type for f in b.schema}
            keys = b.column(list(keep).index(key)).to_numpy()
            edge = np.concatenate([[True], keys[1:] != keys[:-1]])
            start = np.flatnonzero(edge)
            run = np.cumsum(edge) - 1
            columns = []
            new = np.zeros(len(before), np.int64)
            for i, m in enumerate([None, *measures]):
                v = np.ones(b.num_rows, np.int64) if m is None else b.column(list(keep).index(m)).to_numpy()
                total = np.cumsum(v)
                base = (total - v)[start]
                sums = total - v - base[run]
                if keys[0] == last:
                    sums[: start[1] if len(start) > 1 else None] += state[i]
                columns.append(sums)
                new[i] = sums[-1] + v[-1]
            first = int(keys[0]) if first is None else first
            last, state = keys[-1], new
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.nulls(b.num_rows, pa.int64()), *map(pa.array, columns)], names=schema.names)
        if first is not None:
            total = {key: int(last), "part__": part, "first__": first} | dict(zip(before, state.tolist(), strict=True))
            empty = [pa.array([total.get(n)], types.get(n, pa.int32() if n == "part__" else pa.int64())) for n in schema.names]
            yield pa.RecordBatch.from_arrays(empty, names=schema.names)

    rows = stored(ordered.mapInArrow(local, schema), "within")
    carried, last, state = {}, None, [0] * len(before)
    for r in sorted(rows.where("first__ is not null").select(key, "part__", "first__", *before).collect(), key=lambda r: r["part__"]):  # one row a partition
        if last is not None and r["first__"] == last:
            carried[r["part__"]] = (last, [(x + (1 << 63)) % (1 << 64) - (1 << 63) for x in state])
        on = last == r[key] == r["first__"]
        state = [(state[i] if on else 0) + r[n] for i, n in enumerate(before)]
        last = r[key]

    def shifted(batches):
        for b in batches:
            keys, part = b.column(list(keep).index(key)).to_numpy(), b.column(len(keep)).to_numpy()
            sums = [b.column(len(keep) + 2 + i).to_numpy().copy() for i in range(len(before))]
            for p in np.unique(part).tolist():
                if p in carried:
                    mine = (part == p) & (keys == carried[p][0])
                    for s, add in zip(sums, carried[p][1], strict=True):
                        s[mine] += np.int64(add)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, sums)], names=[*keep, *before])

    return rows.where("first__ is null").mapInArrow(shifted, StructType([*kept, *longs]))
