"""Targets and the places of guides on them: ids, senses, ranges and flanks."""

from __future__ import annotations

from collections.abc import Mapping
from string import Template

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.sequences import reverse_complement

# Fixed value: bases that exact searches take; others are ambiguous.
STANDARD_BASES = "ACGTU"


def id_part(seqid: Column, place: int, sep: str = "|") -> Column:
    """The part of an id at ``place`` (from 0; negative from the end); null beyond its parts."""
    parts = F.split(seqid, f"[{sep}]")
    return F.try_element_at(parts, F.lit(place + 1 if place >= 0 else place))


def rendered_id(template: str, values: Mapping[str, Column]) -> Column:
    """An id by a ``$name`` template; null values become dots.  An unknown name raises KeyError."""
    marks = {k: f"\0{k}\0" for k in values}
    pieces = Template(template).substitute(marks).split("\0")
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit(".")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def plus_or_minus(sense: Column) -> Column:
    """+ for ``+`` and ``sense``, null for ``NA`` and null, else -."""
    return F.when(sense.isin("+", "sense"), "+").when(sense != "NA", "-")


def sense_from_parent(parent_sense: Column, strand: Column) -> Column:
    """Sense of a hit: + where its strand is the parent's sense, null where either is unknown."""
    parent = plus_or_minus(parent_sense)
    return F.when(strand.isNull() | parent.isNull(), None).when(parent == strand, "+").otherwise("-")


def parent_sense(sense: Column, strand: Column, words: bool = False) -> Column:
    """Sense of the parent from a hit's sense and strand; ``words``: sense, antisense, NA."""
    value = F.when(sense.isNull() | strand.isNull(), None).when(sense == strand, "+").otherwise("-")
    return F.when(value == "+", "sense").when(value == "-", "antisense").otherwise("NA") if words else value


def adjusted_range(start: Column, end: Column, length: Column, strand: Column, other: Column | None = None) -> tuple[Column, Column]:
    """The range as it stands where the strand is + (or equals ``other``: the target's strand
    or its sense), counted from the other end where not; null where either is unknown."""
    kept = strand == (F.lit("+") if other is None else other)
    return F.when(kept, start).when(~kept, length - end), F.when(kept, end).when(~kept, length - start)


def flanks(seq: Column, start: Column, end: Column, strand: Column, length: int = 100) -> tuple[Column, Column]:
    """Up to ``length`` bases before and after a hit (+ coordinates), along its strand."""
    before = F.substr(seq, F.greatest(start - length, F.lit(0)) + 1, F.least(start, F.lit(length)))
    after = F.substr(seq, end + 1, F.lit(length))
    return F.when(strand == "-", reverse_complement(after)).otherwise(before), F.when(strand == "-", reverse_complement(before)).otherwise(after)


def unambiguous(seq: Column) -> Column:
    return seq.rlike(f"^[{STANDARD_BASES}{STANDARD_BASES.lower()}]+$")


def in_sequences(guides: DataFrame, fasta: DataFrame, keep: bool = True) -> DataFrame:
    """Guides (grna) that stand in ``fasta`` (seq), whatever the case; with keep=False those that don't."""
    listed = fasta.select(F.upper("seq").alias("seq__")).distinct()
    return guides.join(listed, F.upper("grna") == F.col("seq__"), "left_semi" if keep else "left_anti")


def exclude_check(guides: DataFrame, fasta: DataFrame, name: str = "exclude") -> DataFrame:
    """``guides`` with a check that fails where the sequence stands in ``fasta``, whatever the case."""
    listed = fasta.select(F.upper("seq").alias("seq__")).distinct().withColumn("listed__", F.lit(True))
    return guides.join(listed, F.upper("grna") == F.col("seq__"), "left").withColumn(name, F.col("listed__").isNull()).drop("seq__", "listed__")


def distance_to_5prime(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """(a, b, common, distance): of guides a and b of ``pairs``, the mean position of a's hits
    less that of b's, on the targets that both hit; pairs without a common target are left out."""
    at = F.when(F.col("sense") == "-", F.col("target_len") - F.col("end")).otherwise(F.col("start"))
    places = hits.groupBy("grna", "target_id").agg(F.sum(at).alias("s"), F.count(at).alias("n"))
    side = lambda k: places.select(F.col("grna").alias(k), "target_id", F.col("s").alias(f"s{k}"), F.col("n").alias(f"n{k}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), ["b", "target_id"])
    per = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), *[F.sum(x).alias(x) for x in ("sa", "na", "sb", "nb")])
    return per.select("a", "b", "common", (F.col("sa") / F.col("na") - F.col("sb") / F.col("nb")).alias("distance"))


def with_target_lengths(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Hits whose target's length is taken from ``targets`` (target_id, seq), else kept as read."""
    sizes = targets.groupBy("target_id").agg(F.max(F.length("seq")).alias("len__"))
    return hits.join(sizes, "target_id", "left").withColumn("target_len", F.coalesce("len__", "target_len")).drop("len__")
