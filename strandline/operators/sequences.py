"""Nucleotide sequences: scalar functions and guide enumeration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.pam import Pam
from strandline.operators.joins import dealt, merged_in_joins
from strandline.operators.prefix import global_prefix
from strandline.operators.ranges import intersected, merged

#: Windows of a piece into which sequences are cut.
PIECE = 512
# Complements of IUPAC codes; amino acids of the standard code over ACGT x ACGT x ACGT.
BASES, COMPLEMENTS = "ACGTURYSWKMBDHVNacgturyswkmbdhvn", "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"
STANDARD_CODE = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"


# What other NCBI genetic codes read differently from the standard one.
OTHER_CODES = {
    1: {}, 2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"}, 3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    4: {"TGA": "W"}, 5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"}, 6: {"TAA": "Q", "TAG": "Q"}, 9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
    10: {"TGA": "C"}, 11: {}, 12: {"CTG": "S"}, 13: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"}, 14: {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"},
    16: {"TAG": "L"}, 21: {"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S", "AAA": "N"}, 22: {"TCA": "*", "TAG": "L"}, 23: {"TTA": "*"}, 24: {"AGA": "S", "AGG": "K", "TGA": "W"}, 25: {"TGA": "G"},
}


def genetic_code(number: int = 1) -> str:
    """Amino acids over ACGT x ACGT x ACGT of an NCBI genetic code."""
    if number not in OTHER_CODES:
        raise ValueError(f"no such genetic code: {number}")
    code = list(STANDARD_CODE)
    for codon, amino in OTHER_CODES[number].items():
        code[sum("ACGT".index(b) * 4 ** (2 - i) for i, b in enumerate(codon))] = amino
    return "".join(code)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def strandless(df: DataFrame, seq: str) -> DataFrame:
    """``df`` with ``either``, the same text for the sequence ``seq`` (upper case) and its reverse
    complement, in its place: the lesser of both, U read as T.  (seq)_turned tells which of the two it was,
    (seq)_other is the sequence itself where it has a U and cannot be told from these.  Rows without it go."""
    text, rna = F.col(seq), F.contains(F.col(seq), F.lit("U"))
    plain = F.when(rna, F.translate(text, "U", "T")).otherwise(text)
    either = F.coalesce(F.least(plain, reverse_complement(plain)), F.lit(""))  # never null, so that a join has nothing to test
    return df.where(text.isNotNull()).withColumns({"either": either, f"{seq}_turned": plain != either, f"{seq}_other": F.when(rna, text)}).drop(seq)


def of_strandless(seq: str) -> Column:
    """The sequence that ``strandless`` took."""
    return F.coalesce(f"{seq}_other", F.when(F.col(f"{seq}_turned"), reverse_complement(F.col("either"))).otherwise(F.col("either")))


def gc_content(seq: Column) -> Column:
    """(G + C) / length without gaps; other letters count in the length; null for none."""
    bare = F.upper(F.replace(seq, F.lit("-"), F.lit("")))
    return F.length(F.regexp_replace(bare, "[^GC]", "")) / F.nullif(F.length(bare), F.lit(0))


def translated(seq: Column, code: str = STANDARD_CODE) -> Column:
    """Peptide of the whole sequence, past stop codons; X for codons with other letters."""

    def amino(i: Column) -> Column:
        index = [F.instr(F.lit("ACGT"), F.substr(seq, i + k, F.lit(1))) - 1 for k in range(3)]
        known = (index[0] >= 0) & (index[1] >= 0) & (index[2] >= 0)
        return F.when(known, F.substr(F.lit(code), index[0] * 16 + index[1] * 4 + index[2] + 1, F.lit(1))).otherwise("X")

    starts = F.sequence(F.lit(1), F.length(seq) - 2, F.lit(3))
    return F.when(F.length(seq) < 3, "").otherwise(F.array_join(F.transform(starts, amino), ""))


def byte_letters(seq: Column) -> Column:
    """The sequence as binary of one byte a letter, so that a slice costs its own length and
    not its distance from the start; letters beyond ASCII become ``?``."""
    plain = F.when(F.octet_length(seq) == F.length(seq), seq).otherwise(F.regexp_replace(seq, r"[^\x00-\x7f]", "?"))
    return plain.cast("binary")


def letters(part: Column, at: Column, length: Column) -> Column:
    """``length`` letters of the bytes ``part`` from ``at`` (from 0)."""
    return F.substring(part, at + 1, length).cast("string")


def pieces(df: DataFrame, keep: Sequence[str], length: int, left: int = 0, right: int = 0, seq: str = "s") -> DataFrame:
    """(keep..., n, base, lo, part): sequences of n bases cut into overlapping pieces of
    ``PIECE`` windows of ``length`` bases, the first at base, with ``left`` and ``right``
    bases around them; the piece begins at lo.  Pieces are bytes sliced from bytes, so the
    work grows with a sequence's length; ``letters`` cuts text out of them."""
    n = F.length(seq)
    rows = df.where(n >= length).select(*keep, n.alias("n"), byte_letters(F.col(seq)).alias("s__"))
    rows = rows.select(*keep, "n", "s__", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - length) / PIECE).cast("int"))).alias("c__"))
    base = F.col("c__") * PIECE
    lo = F.greatest(base - left, F.lit(0))
    return merged_in_joins(rows.select(*keep, "n", base.alias("base"), lo.alias("lo"), F.substring("s__", lo + 1, base - lo + PIECE + length - 1 + right).alias("part")))


def windows(df: DataFrame, keep: Sequence[str], length: int, left: int = 0, right: int = 0, seq: str = "s") -> DataFrame:
    """(keep..., n, at, part, lo): a row for each window of ``length`` bases of a sequence of
    n bases, with the piece (see ``pieces``) that holds it."""
    cut = pieces(df, keep, length, left, right, seq)
    return cut.select(*keep, "n", "lo", "part", F.explode(F.sequence(F.col("base"), F.least(F.col("base") + PIECE, F.col("n") - length + 1) - 1)).alias("at"))


def guides(targets: DataFrame, pam: Pam, keep: Sequence[str] = ("target_id",)) -> DataFrame:
    """(keep..., grna, start, end, strand): every window of the guide's length next to the
    motif, on both strands, overlapping ones too; start and end count on the + strand.

    The motif is tested on the few bases beside a window before the window is cut out.
    """
    length, (left, right) = pam.length, pam.widths
    strands = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.upper("seq").alias("s")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.upper("seq")).alias("s"))))
    both = windows(targets.where(F.length("seq") >= length).select(*keep, strands.alias("x")).select(*keep, "x.strand", "x.s"), [*keep, "strand"], length, left, right)
    within = F.col("at") - F.col("lo")
    if pam.before:
        lo = F.greatest(F.lit(0), within - left)
        both = both.where(letters(F.col("part"), lo, within - lo).rlike(f"{pam.before}$"))
    if pam.after:
        both = both.where(letters(F.col("part"), within + length, F.lit(right)).rlike(f"^{pam.after}"))
    start = F.when(F.col("strand") == "+", F.col("at")).otherwise(F.col("n") - F.col("at") - length)
    return both.select(*keep, letters(F.col("part"), within, F.lit(length)).alias("grna"), start.alias("start"), (start + length).alias("end"), "strand")


def named_guides(hits: DataFrame, order: Sequence[str], prefix: str = "gRNA") -> DataFrame:
    """(grna, grna_id): numbers by first appearance, with at least three digits."""
    first = hits.groupBy("grna").agg(F.min(F.struct(*order)).alias("ord"))
    ordered = global_prefix(first, ["ord", "grna"], [])
    return ordered.select("grna", F.format_string(f"{prefix}_%03d", F.col("row_before") + 1).alias("grna_id"))


def exact_occurrences(queries: DataFrame, subjects: DataFrame, length: int) -> DataFrame:
    """(query, molecule, start, end, strand): where queries of one length stand in the
    subjects, overlapping and on both strands; windows meet queries by equality."""
    found = windows(subjects.select("molecule", F.upper("seq").alias("s")), ["molecule"], length)
    found = found.select("molecule", F.col("at").alias("start"), letters(F.col("part"), F.col("at") - F.col("lo"), F.lit(length)).alias("w"))
    q = queries.select(F.upper("query").alias("query")).distinct()
    forms = q.select("query", F.col("query").alias("w"), F.lit("+").alias("strand")).unionByName(q.select("query", reverse_complement(F.col("query")).alias("w"), F.lit("-").alias("strand")))
    return found.join(forms, "w").select("query", "molecule", "start", (F.col("start") + length).alias("end"), "strand")


def joined_pieces(df: DataFrame, key: str) -> DataFrame:
    """(key, seq): pieces of a key in strand order, reverse-complemented on -."""
    pieces = F.array_sort(F.collect_list(F.struct("start", "piece")))
    out = df.groupBy(key).agg(F.first("strand").alias("strand"), F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("seq"))
    return out.select(key, F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def feature_sequences(parts: DataFrame, molecules: DataFrame, keys: Sequence[str], within: DataFrame | None = None, translate: bool = False, code: int = 1) -> DataFrame:
    """(keys..., places, seq): the union of a feature's parts (keys..., target_id, strand,
    start, end) cut out of its molecule (target_id, seq) in order, the other strand for -;
    ``within`` (keys..., start, end, in molecule coordinates) restricts the parts, and
    ``translate`` gives the peptide.  places: 1-based inclusive ranges."""
    group, n = [*keys, "target_id", "strand"], parts.count()
    ranges = merged(dealt(parts.select(*group, "start", "end"), keys, n), group)
    if within is not None:
        strands = ranges.select(*group).distinct()
        ranges = intersected(ranges, within.join(strands, list(keys)).select(*group, "start", "end"), group)
    # A feature's ranges stay together from here on: one row of it meets the molecule.
    spans = ranges.groupBy(*group).agg(F.collect_list(F.struct("start", "end")).alias("p"))
    cut = lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.substr("seq", p["start"] + 1, p["end"] - p["start"]).alias("piece"))
    pieces = dealt(spans, ["target_id"], n).join(molecules, "target_id").select(*keys, "strand", F.transform("p", cut).alias("p"))
    ordered = F.array_sort(F.flatten(F.collect_list("p")))
    place = lambda p: F.concat((p["start"] + 1).cast("string"), F.lit("-"), p["end"].cast("string"))
    out = dealt(pieces, keys, n).groupBy(*keys, "strand").agg(ordered.alias("p")).select(*keys, "strand", F.array_join(F.transform("p", place), ",").alias("places"), F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("seq"))
    seq = F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    out = out.select(*keys, "places", seq.alias("seq"))
    return out.withColumn("seq", translated(F.upper("seq"), genetic_code(code))) if translate else out


def region_sequences(regions: DataFrame, molecules: DataFrame, source: str | None, ties: Sequence[str] = ()) -> DataFrame:
    """(seq_id, seq): regions (molecule, start, end) cut out of their molecules, named
    ``source|molecule|number|start-end``; numbers count within a molecule by start (``ties``
    columns first).  Without a ``source`` both tables have a column of that name."""
    keys = ["molecule"] if source is not None else ["source", "molecule"]
    order = Window.partitionBy(*keys).orderBy(*ties, "start", "end")
    rows = regions.withColumn("i__", F.row_number().over(order)).join(molecules, keys)
    name = F.concat_ws("|", F.col("source") if source is None else F.lit(source), "molecule", F.col("i__").cast("string"), F.concat((F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string")))
    return rows.select(name.alias("seq_id"), F.substr("seq", F.col("start") + 1, F.col("end") - F.col("start")).alias("seq"))
