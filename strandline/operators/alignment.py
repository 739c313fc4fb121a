"""Gapped alignments: positions, effective feature ranges, feature checks, inferred annotation.

Alignments are rows (aln_id, seq_id, aln); rows of one aln_id have one length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.joins import merged_in_joins
from strandline.operators.ranges import merged, range_join

# Fixed value: what aligners put before the ids of rows that they turned round.
TURNED = "_R_"


#: Bases, or columns, by which positions meet the runs of their row.
BIN = 4_096


def runs_of(alignment: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., col, before, size, gap): the runs of bases, and those of gaps, of each row: the
    column where they begin, the row's bases before them, and their length."""
    pieces = alignment.select(*keep, F.posexplode(F.regexp_extract_all("aln", F.lit("(-+|[^-]+)"), 1)).alias("k", "piece"))
    pieces = pieces.select(*keep, "k", F.length("piece").alias("size"), F.col("piece").startswith("-").alias("gap"))
    earlier = Window.partitionBy(*keep).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("int")
    return merged_in_joins(pieces.select(*keep, so_far(F.col("size")).alias("col"), so_far(F.when(~F.col("gap"), F.col("size")).otherwise(0)).alias("before"), "size", "gap"))


def placed(rows: DataFrame, runs: DataFrame, keys: Sequence[str], positions: Mapping[str, Column]) -> DataFrame:
    """``rows`` with the alignment columns of ``positions`` (name: which of their row's bases,
    from 0); null where the row has no such base.  Positions meet ``runs`` by bins."""
    bins = F.sequence(F.floor(F.col("before") / BIN), F.floor((F.col("before") + F.col("size") - 1) / BIN))
    bases = runs.where(~F.col("gap")).select(*[F.col(k).alias(f"{k}__") for k in keys], F.col("col").alias("col__"), F.col("before").alias("from__"), (F.col("before") + F.col("size")).alias("to__"), F.explode(bins).alias("bin__"))
    for name, position in positions.items():
        at = F.col("at__")
        same = (F.floor(at / BIN) == F.col("bin__")) & (at >= F.col("from__")) & (at < F.col("to__"))
        for k in keys:
            same = same & (F.col(k) == F.col(f"{k}__"))
        met = rows.withColumn("at__", position).join(bases, same, "left").withColumn(name, F.col("col__") + at - F.col("from__"))
        rows = met.drop("at__", *bases.columns)
    return rows


def gapped_position(aln: Column, pos: Column) -> Column:
    """The alignment column of the pos-th base (from 0)."""
    letters = F.filter(F.split(aln, ""), lambda c: c != "")
    places = F.filter(F.transform(letters, lambda c, i: F.when(c != "-", i)), lambda i: i.isNotNull())
    return F.get(places, pos)


def bases_before(aln: Column, col: Column) -> Column:
    """How many bases a row has before a column."""
    return F.length(F.replace(F.substr(aln, F.lit(1), col), F.lit("-"), F.lit("")))


def base_ranges(alignment: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Runs of alignment columns that hold a base."""
    return runs_of(alignment, keep).where(~F.col("gap")).select(*keep, F.col("col").alias("start"), (F.col("col") + F.col("size")).alias("end"))


def _runs_with(alignment: DataFrame, ranges: DataFrame) -> DataFrame:
    """Runs of the rows that have ranges."""
    return runs_of(alignment.join(merged_in_joins(ranges.select("aln_id", "seq_id").distinct()), ["aln_id", "seq_id"], "left_semi"), ["aln_id", "seq_id"])


def _columns(runs: DataFrame, ranges: DataFrame) -> DataFrame:
    keys = ["aln_id", "seq_id"]
    ends = placed(ranges.where("end > start").select(*keys, "start", "end"), runs, keys, {"first": F.col("start"), "last": F.col("end") - 1})
    return merged(ends.where("first is not null and last is not null").select(*keys, F.col("first").alias("start"), (F.col("last") + 1).alias("end")), keys)


def _parted(whole: DataFrame, runs: DataFrame) -> DataFrame:
    """(aln_id, seq_id, start, end, gap): column ranges cut where bases and gaps meet."""
    keys = ["aln_id", "seq_id"]
    both = range_join(whole, runs.select(*keys, F.col("col").alias("r_start"), (F.col("col") + F.col("size")).alias("r_end"), "gap"), keys, BIN)
    return both.select(*keys, F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"), "gap")


def column_ranges(alignment: DataFrame, ranges: DataFrame, without_gaps: bool = False) -> DataFrame:
    """(aln_id, seq_id, start, end) in alignment columns of ``ranges`` (aln_id, seq_id, start,
    end) that count a row's own bases; ``without_gaps`` leaves out the row's gap columns."""
    runs = _runs_with(alignment, ranges)
    whole = _columns(runs, ranges)
    return _parted(whole, runs).where(~F.col("gap")).drop("gap") if without_gaps else whole


def effective_ranges(alignment: DataFrame, features: DataFrame, max_insertion: int = 15) -> DataFrame:
    """(aln_id, seq_id, gene, start, end): for each row and each reference gene of its
    alignment the columns that count as the gene's feature.

    ``features`` (aln_id, seq_id, start, end) are feature ranges of reference rows, in their
    own bases.  A gap of the reference within its feature counts for a row that has at most
    ``max_insertion`` bases there (each gap by itself).  A row that is a reference itself is
    compared with its own ranges only.
    """
    runs = _runs_with(alignment, features)
    parts = _parted(_columns(runs, features), runs).withColumnRenamed("seq_id", "gene")
    references = merged_in_joins(features.select("aln_id", F.col("seq_id").alias("ref")).distinct())
    rows = alignment.join(references, (alignment["aln_id"] == references["aln_id"]) & (alignment["seq_id"] == references["ref"]), "left").select(alignment["aln_id"], "seq_id", "aln", "ref")
    own = F.col("ref").isNull() | (F.col("ref") == F.col("gene"))
    inserted = F.length(F.replace(F.substr("aln", F.col("start") + 1, F.col("end") - F.col("start")), F.lit("-"), F.lit("")))
    kept = rows.join(merged_in_joins(parts), "aln_id").where(own & (~F.col("gap") | (inserted <= max_insertion)))
    return merged(kept.select("aln_id", "seq_id", "gene", "start", "end"), ["aln_id", "seq_id", "gene"])


def aligned_hits(hits: DataFrame, alignment: DataFrame) -> DataFrame:
    """Hits (hit_id, target_id, start, end, target_len) with the row of their target, which
    may stand turned round, as alignment columns: (hit_id, aln_id, seq_id, sense, start, end).
    Hits whose target is not aligned are left out."""
    named = alignment.select("aln_id", "seq_id", F.regexp_replace("seq_id", f"^{TURNED}", "").alias("target_id"), F.col("seq_id").startswith(TURNED).alias("turned"))
    rows = hits.select("hit_id", "target_id", "start", "end", "target_len").join(merged_in_joins(named), "target_id")
    start = F.when(F.col("turned"), F.col("target_len") - F.col("end")).otherwise(F.col("start"))
    end = F.when(F.col("turned"), F.col("target_len") - F.col("start")).otherwise(F.col("end"))
    rows = rows.select("hit_id", "aln_id", "seq_id", F.when(F.col("turned"), "-").otherwise("+").alias("sense"), start.alias("from"), end.alias("to"))
    keys = ["aln_id", "seq_id"]
    found = placed(rows, runs_of(alignment, keys), keys, {"start": F.col("from"), "last": F.col("to") - 1})
    return found.select("hit_id", *keys, "sense", "start", (F.col("last") + 1).alias("end"))


def feature_check(hits: DataFrame, alignment: DataFrame, features: DataFrame, max_insertion: int = 15, least: int = 1, fraction: float = 0.0) -> DataFrame:
    """(hit_id, sense, n_within, feature): whether a hit lies within the effective ranges of
    at least ``least`` reference genes and of ``fraction`` of all of its alignment.  Hits
    whose target is not aligned have no row: their check stays unset."""
    placed = aligned_hits(hits, alignment)
    ranges = effective_ranges(alignment, features, max_insertion).select("aln_id", "seq_id", "gene", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    inside = placed.join(merged_in_joins(ranges), ["aln_id", "seq_id"], "left").groupBy("hit_id", "sense", "gene").agg(F.max((F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end"))).alias("ok"))
    per = inside.groupBy("hit_id", "sense").agg(F.count_if("ok").alias("n_within"), F.avg(F.coalesce("ok", F.lit(False)).cast("int")).alias("share"))
    return per.select("hit_id", "sense", "n_within", ((F.col("n_within") >= least) & (F.col("share") >= fraction)).alias("feature"))


def within_features(hits: DataFrame, ranges: DataFrame, least: int, fraction: float) -> DataFrame:
    """(hit_id, n_within, feature): how many reference genes' ranges contain the hit."""
    per = hits.join(ranges, "target_id").groupBy("hit_id", "gene").agg(F.max((F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end"))).alias("ok"))
    out = per.groupBy("hit_id").agg(F.count_if("ok").alias("n_within"), F.avg(F.col("ok").cast("int")).alias("share"))
    return out.select("hit_id", "n_within", ((F.col("n_within") >= least) & (F.col("share") >= fraction)).alias("feature"))


def inferred_annotation(alignment: DataFrame) -> DataFrame:
    """(seqid, type, id, parent, start, end, phase) of genes aligned with their coding
    sequences; rows (aln_id, seq_id, aln, kind), kind ``gene`` for one row of each alignment
    and ``cds`` for the others.

    Coordinates count the gene's bases.  Each run of a coding row's bases is a CDS feature,
    numbered along the gene, with the bases before it modulo 3 as its phase; an mRNA spans
    them.  A coding row without bases gives nothing.
    """
    gene = alignment.where("kind = 'gene'").select("aln_id", F.col("seq_id").alias("seqid"), F.col("aln").alias("g"))
    coding = alignment.where("kind = 'cds'")
    runs = base_ranges(coding, ["aln_id", "seq_id"]).join(coding.select("aln_id", "seq_id", "aln"), ["aln_id", "seq_id"]).join(merged_in_joins(gene), "aln_id")
    start, end = bases_before(F.col("g"), F.col("start")), bases_before(F.col("g"), F.col("end"))
    runs = runs.select("seqid", "seq_id", start.alias("start"), end.alias("end"), (bases_before(F.col("aln"), F.col("start")) % 3).alias("phase"), F.col("start").alias("col"))
    number = F.row_number().over(Window.partitionBy("seqid", "seq_id").orderBy("col"))
    cds = runs.select("seqid", F.lit("CDS").alias("type"), F.concat("seq_id", F.lit(".cds"), F.lpad(number.cast("string"), 6, "0")).alias("id"), F.col("seq_id").alias("parent"), "start", "end", "phase")
    none = F.lit(None)
    mrna = runs.groupBy("seqid", "seq_id").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("seqid", F.lit("mRNA").alias("type"), F.col("seq_id").alias("id"), F.col("seqid").alias("parent"), "start", "end", none.cast("int").alias("phase"))
    genes = gene.select("seqid", F.lit("gene").alias("type"), F.col("seqid").alias("id"), none.cast("string").alias("parent"), F.lit(0).alias("start"), F.length(F.replace("g", F.lit("-"), F.lit(""))).alias("end"), none.cast("int").alias("phase"))
    return genes.unionByName(mrna).unionByName(cds)
