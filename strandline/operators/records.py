"""Guides, hits, sources and gene sets as tables: look-ups, set algebra and consistency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# All genes asked for, none of them.
ALL, NONE = ".", "-"


def hits_of(guides: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with the columns of their guide."""
    return hits.join(guides, "grna")


def by_id(guides: DataFrame, ids: DataFrame) -> DataFrame:
    """(grna_id, grna, n): the guide of each id asked for; of several (n) the smallest sequence."""
    per = guides.groupBy("grna_id").agg(F.min("grna").alias("grna"), F.count(F.lit(1)).alias("n"))
    return per.join(ids.select("grna_id").distinct(), "grna_id", "left_semi")


def pruned(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Two tables without the rows whose key the other lacks."""
    return a.join(b.select(key).distinct(), key, "left_semi"), b.join(a.select(key).distinct(), key, "left_semi")


def first_sources(sources: DataFrame) -> DataFrame:
    """(alias, fname): a file that is given several times keeps its first alias (column ord)."""
    return sources.groupBy("fname").agg(F.min_by("alias", "ord").alias("alias")).select("alias", "fname")


def numbered_sources(fnames: Sequence[str], prefix: str, start: int = 1) -> list[tuple[str, str]]:
    """(alias, file name) with aliases ``prefix_001`` and on, a repeated file once."""
    return [(f"{prefix}_{i:03d}", f) for i, f in enumerate(dict.fromkeys(fnames), start)]


def set_algebra(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Union, intersection, difference and symmetric difference of two tables of sets (one
    row a member set)."""
    return {
        "union": a.union(b).distinct(), "intersection": a.intersect(b), "difference": a.exceptAll(b).distinct().subtract(b),
        "symmetric_difference": a.subtract(b).union(b.subtract(a)),
    }


def without_members(groups: DataFrame, gone: DataFrame) -> DataFrame:
    """(cg, grna) without the guides of ``gone``; groups left empty disappear."""
    return groups.join(gone.select("grna").distinct(), "grna", "left_anti")


def with_members(groups: DataFrame, new: DataFrame) -> DataFrame:
    """(cg, targets, grna) and the guides of ``new`` (grna, targets) in the group of the same
    targets; ones that fit no group are left out."""
    joined = new.join(groups.select("cg", "targets").distinct(), "targets").select("cg", "targets", "grna")
    return groups.select("cg", "targets", "grna").unionByName(joined).distinct()


def emptied(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups (cg) that have no member any more."""
    return groups.select("cg").distinct().join(members.select("cg").distinct(), "cg", "left_anti")


def ranked_solutions(solutions: DataFrame) -> DataFrame:
    """(solution, size, redundancy, max_coverage, min_coverage, rank) of rows (solution, member,
    targets): fewest members first, then least redundancy, then the largest member."""
    flat = F.size(F.array_distinct(F.flatten(F.collect_list("targets"))))
    per = solutions.groupBy("solution").agg(
        F.count(F.lit(1)).alias("size"), (F.sum(F.size("targets")) - flat).alias("redundancy"),
        F.max(F.size("targets")).alias("max_coverage"), F.min(F.size("targets")).alias("min_coverage"))
    from strandline.operators.prefix import global_prefix

    ranked = global_prefix(per, ["size", "redundancy", F.desc("max_coverage"), "solution"], [])
    return ranked.withColumn("rank", F.col("row_before") + 1).drop("row_before")


def mask_gene_sets(mask: DataFrame, unmask: DataFrame, genes: DataFrame, clusters: DataFrame, priority: str | None = None) -> DataFrame:
    """(kind, gene) of rows (gene) or (cluster) to mask and to unmask.

    ``mask`` and ``unmask`` have columns gene and cluster, one of them null; ``clusters``
    (cluster, gene) expands clusters; ``.`` stands for all ``genes`` asked for, ``-`` takes
    them away; both together raise ValueError, as does a gene on both sides without a
    ``priority`` (mask or unmask), which otherwise keeps it.
    """

    def expanded(rows: DataFrame) -> DataFrame:
        named = rows.where(F.col("gene").isNotNull()).select("gene")
        found = named.unionByName(rows.join(clusters.withColumnRenamed("gene", "member"), "cluster").select(F.col("member").alias("gene"))).distinct()
        signs = {r["gene"] for r in found.where(F.col("gene").isin(ALL, NONE)).collect()}  # two at most
        if signs == {ALL, NONE}:
            raise ValueError(f"{ALL!r} and {NONE!r} exclude each other")
        found = found.where(~F.col("gene").isin(ALL, NONE))
        asked = genes.select("gene").distinct()
        return found.union(asked).distinct() if ALL in signs else found.subtract(asked) if NONE in signs else found

    m, u = expanded(mask), expanded(unmask)
    if priority is None and not m.intersect(u).isEmpty():
        raise ValueError("genes to be masked and unmasked, and no priority")
    m, u = (m, u.subtract(m)) if priority == "mask" else (m.subtract(u), u) if priority == "unmask" else (m, u)
    return m.select(F.lit("mask").alias("kind"), "gene").unionByName(u.select(F.lit("unmask").alias("kind"), "gene"))
