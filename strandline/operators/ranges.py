"""Algebra of half-open integer ranges, as rows and as arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strandline.operators.joins import merged_in_joins


def within(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start >= b_start) & (a_end <= b_end)


def within_any(start: Column, end: Column, ranges: Column) -> Column:
    """Whether one of an array of (start, end) structs contains the range."""
    return F.exists(ranges, lambda r: (start >= r["start"]) & (end <= r["end"]))


def converted(start: Column, end: Column, base_from: int, closed_from: bool, base_to: int, closed_to: bool) -> tuple[Column, Column]:
    """The same positions counted from another base, with the end in or out."""
    shift = base_to - base_from
    return start + shift, end + shift + int(closed_from) - int(closed_to)


def to_positions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The positions of each key's ranges, each once: ranges are joined first, so only they are
    shuffled and no position is."""
    return merged(df.where("end > start").select(*keys, "start", "end"), keys).select(*keys, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))


def to_ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal runs of the distinct positions of each key.  Rows that follow each other with
    positions that do become one range where they stand, before ranges are joined."""
    rows = df.select(*keys, "pos")
    first = rows.schema.fields
    kept = [*first[:-1], StructField("start", first[-1].dataType), StructField("end", first[-1].dataType)]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = b.column(len(keys))
            cut = np.ones(b.num_rows, bool)
            cut[1:] = pc.fill_null(pc.not_equal(pc.subtract(pos[1:], pos[:-1]), 1), True).to_numpy(zero_copy_only=False)
            for k in range(len(keys)):
                cut[1:] |= pc.fill_null(pc.not_equal(b.column(k)[1:], b.column(k)[:-1]), True).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(cut)
            last = pc.add(pos.take(pa.array(np.append(at[1:], b.num_rows) - 1 if len(at) else at)), pa.scalar(1, pos.type))
            here = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(here) for k in range(len(keys))), pos.take(here), last], names=[f.name for f in kept])

    found = rows.where("pos is not null").mapInArrow(runs, StructType(kept))
    return merged(found, keys)


def merged(df: DataFrame, keys: Sequence[str], gap: int = 0, extra: Sequence[Column] = ()) -> DataFrame:
    """Ranges of a key joined where at most ``gap`` lies between them, with more
    aggregates; no positions are listed, so ranges may be of any length."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    starts = (F.col("start") > F.max("end").over(before) + gap).cast("int")
    marked = df.withColumn("new__", F.coalesce(starts, F.lit(1))).withColumn("island__", F.sum("new__").over(upto))
    return marked.groupBy(*keys, "island__").agg(F.min("start").alias("start"), F.max("end").alias("end"), *extra).drop("island__")


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bin_size: int, how: str = "inner") -> DataFrame:
    """Pairs whose ranges (start, end) and (r_start, r_end) overlap.  Both sides are laid
    into bins of the coordinate and meet by equality, so no side is compared whole; a pair
    is reported in the bin where its overlap begins, once.  ``left`` keeps unmatched rows."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / bin_size)))
    named = left.withColumn("row__", F.monotonically_increasing_id()) if how == "left" else left
    a, b = named.withColumn("bin__", bins("start", "end")), merged_in_joins(right.withColumn("bin__", bins("r_start", "r_end")))
    same = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    pairs = a.join(b, [*keys, "bin__"]).where(same & (F.floor(F.greatest("start", "r_start") / bin_size) == F.col("bin__"))).drop("bin__")
    if how == "inner":
        return pairs
    lonely = a.select(*keys, "bin__", "row__", "start", "end").join(b.select(*keys, "bin__", "r_start", "r_end"), [*keys, "bin__"]).where(same).select("row__").distinct()
    return pairs.drop("row__").unionByName(named.join(lonely, "row__", "left_anti").drop("row__"), allowMissingColumns=True)


def intersected(a: DataFrame, b: DataFrame, keys: Sequence[str], bin_size: int = 1000) -> DataFrame:
    other = merged(b, keys).select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    both = range_join(merged(a, keys), other, keys, bin_size)
    return both.select(*keys, F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))


def subtracted(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What of the ranges of ``a`` no range of ``b`` covers.  The ends of both unions are
    swept in order, so no positions are listed: a stretch begins where a begins or b ends
    and counts while a is open and b is not."""
    edge = lambda df, d, e: merged(df, keys).select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(d).alias("da"), F.lit(e).alias("db")), F.struct(F.col("end").alias("at"), F.lit(-d).alias("da"), F.lit(-e).alias("db")))).alias("x")).select(*keys, "x.*")
    places = edge(a.where("end > start"), 1, 0).unionByName(edge(b.where("end > start"), 0, 1)).groupBy(*keys, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = Window.partitionBy(*keys).orderBy("at")
    swept = places.select(*keys, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.sum("da").over(order).alias("a"), F.sum("db").over(order).alias("b"))
    return merged(swept.where("a > 0 and b = 0").select(*keys, "start", "end"), keys)
