"""A design from targets to sets of guides: the operators under the parameters of a ``Design``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.pam import Pam
from strandline.functions.parameters import Design
from strandline.functions.patterns import off_target
from strandline.operators import checks as chk
from strandline.operators import coverage as cov
from strandline.operators import search as sr
from strandline.operators import sequences as sq
from strandline.operators.alignment import feature_check
from strandline.operators.chunks import chunked, slices
from strandline.operators.covers import nonredundant_sets
from strandline.operators.gapped import edit_hits
from strandline.operators.homology import homologous_hsps
from strandline.operators.joins import merged_in_joins
from strandline.operators.ranges import intersected
from strandline.operators.scratch import stored
from strandline.operators.targets import exclude_check
from strandline.sources import text as src
from strandline.sources.registry import registered


@dataclass(frozen=True)
class Designed:
    """What a design gives: candidates with their checks, those that pass, and the sets.

    guides, passing_guides: (grna, grna_id, GC, exclude, background)
    hits, passing_hits: (hit_id, grna, target_id, target_len, sense, strand, start, end, feature)
    sets: (set_number, grna)
    """

    guides: DataFrame
    hits: DataFrame
    passing_guides: DataFrame
    passing_hits: DataFrame
    sets: DataFrame


def candidates(targets: DataFrame, design: Design) -> tuple[DataFrame, DataFrame]:
    """Guides (grna, grna_id) and their hits on ``targets`` (target_id, seq, and sense where it
    is known), stored.  Ids count guides by target, start and strand."""
    sense = F.col("sense") if "sense" in targets.columns else F.lit(None).cast("string")
    rows = targets.select("target_id", "seq", F.length("seq").alias("target_len"), sense.alias("sense"))
    found = sq.guides(rows, Pam.parse(design.pam, design.length), ("target_id", "target_len", "sense"))
    hits = stored(found.select(F.concat_ws("|", "target_id", "start", "strand").alias("hit_id"), "grna", "target_id", "target_len", "sense", "strand", "start", "end"), "design")
    return stored(sq.named_guides(hits, ["target_id", "start", "strand"]), "design"), hits


def background_hits(guides: DataFrame, background: DataFrame, most: int) -> DataFrame:
    """(grna, molecule, strand, start, end, expanded): where guides (grna) of one length stand in
    ``background`` (molecule, seq) with ``most`` edits or fewer, and the alignment a letter a
    column (see ``btop_expanded``): all places without gaps, and the best of those with."""
    own = guides.select(F.upper("grna").alias("grna")).distinct()
    length = own.agg(F.max(F.length("grna"))).first()[0] or 1
    both = F.explode(F.array(*[F.struct("grna", F.lit(strand).alias("strand"), form.alias("form")) for strand, form in (("+", F.col("grna")), ("-", sq.reverse_complement(F.col("grna"))))])).alias("x")
    places = sq.windows(background.select("molecule", F.upper("seq").alias("s")), ["molecule"], length)
    places = places.select("molecule", F.col("at").alias("start"), sq.letters(F.col("part"), F.col("at") - F.col("lo"), F.lit(length)).alias("w"))
    if most == 0:
        # A guide and a window meet by what both strands share, so that a guide is one row, and no text is sent twice.
        met = sq.strandless(places, "w").join(merged_in_joins(sq.strandless(own, "grna")), "either")
        found = met.select("molecule", "start", sq.of_strandless("w").alias("w"), sq.of_strandless("grna").alias("grna"))
        found = found.select("molecule", "start", "w", both).where("x.form = w")
        return found.select("x.grna", "molecule", "x.strand", "start", (F.col("start") + length).alias("end"), F.lit("." * length).alias("expanded"))
    forms = merged_in_joins(own.select(both).select("x.*"))
    near = sr.hamming_hits(forms.select(F.col("form").alias("grna")), places, length, most).select(F.col("grna").alias("form"), "w")
    along = F.array_join(F.zip_with(F.split("form", ""), F.split("w", ""), lambda x, y: F.when(x == y, ".").otherwise("m")), "")
    whole = near.join(forms, "form").join(places, "w").select("grna", "molecule", "strand", "start", (F.col("start") + length).alias("end"), F.when(F.col("strand") == "-", F.reverse(along)).otherwise(along).alias("expanded"))
    n = F.length("grna")
    gapped = edit_hits(guides, background, most, every_end=True).where("gaps > 0")
    return whole.unionByName(gapped.select("grna", "molecule", "strand", "start", "end", sr.btop_expanded(F.col("btop"), F.lit(0), n, n).alias("expanded")))


def risky_hits(guides: DataFrame, background: DataFrame, design: Design) -> DataFrame:
    """(grna, molecule, strand, start, end): hits in ``background`` (molecule, seq) that come too
    close.  With ``offtarget_pattern`` those of at most ``offtarget_edits`` edits that satisfy
    it; otherwise those with fewer mismatches and gaps than ``offtarget_mismatch`` and
    ``offtarget_gap`` (1 at least each), where differing ends count as bases left out, which
    use up what is left of both.  Unless ``offtarget_pamless`` the motif has to stand beside.
    """
    mm, gp = max(1, design.offtarget_mismatch) - 1, max(1, design.offtarget_gap) - 1
    most = design.offtarget_edits if design.offtarget_pattern else mm + gp
    x, n = F.col("expanded"), F.length("grna")
    bases = lambda c: F.length(F.regexp_replace(c, "d", ""))
    found = background_hits(guides, background, most)
    found = found.withColumns({"first": bases(F.regexp_extract(x, "^([mid]*)", 1)), "last": bases(F.regexp_extract(F.regexp_replace(x, "^[mid]*", ""), "([mid]*)$", 1)), "core": F.regexp_replace(F.regexp_replace(x, "^[mid]*", ""), "[mid]*$", "")})
    gaps = sr.counted(F.col("core"), "id")
    if design.offtarget_pattern:
        close = off_target(design.offtarget_pattern, sr.btop_positions(x), design.length, sr.btop_positions(x, from_end=True))
    else:
        close = sr.off_target_total(sr.counted(F.col("core"), "m"), gaps, n - F.col("first") - F.col("last"), design.length, design.offtarget_mismatch, design.offtarget_gap)
    found = found.where(close)
    if not design.offtarget_pamless:
        pam = Pam.parse(design.pam, design.length)
        reach = max(pam.widths) + most + gp
        keyed = stored(found.select("grna", "molecule", "strand", F.col("start").alias("at"), F.col("end").alias("to"), "first", "last", gaps.alias("gaps")).distinct(), "design")
        keyed = keyed.withColumns({"row": F.concat_ws("\0", "grna", "molecule", "strand", "at", "to", "first", "last", "gaps"), "start": F.greatest(F.col("at") - reach, F.lit(0)), "end": F.col("to") + reach})
        seen = slices(keyed, chunked(background), "row")
        motif = sr.near_pam(F.col("seq"), F.col("at") - F.col("start"), F.col("to") - F.col("start"), F.col("strand"), F.col("first"), F.length("grna") - F.col("last"), design.length, F.least("gaps", F.lit(gp)), pam, design.offtarget_gap)
        found = seen.where(motif).select("grna", "molecule", "strand", F.col("at").alias("start"), F.col("to").alias("end"))
    return found.select("grna", "molecule", "strand", "start", "end").distinct()


def screened(guides: DataFrame, background: DataFrame, design: Design, masks: DataFrame | None = None) -> DataFrame:
    """``guides`` with the check ``background``: it fails with any risky hit in ``background``
    (source, molecule, seq) outside the places where ``masks`` (seq_id, seq) stand whole."""
    key = F.concat_ws("\0", "source", "molecule").alias("molecule")
    hits = risky_hits(guides.select("grna"), background.select(key, "seq"), design)
    if masks is not None:
        hidden = sr.masked_regions(masks, background.select("source", "molecule", "seq")).select(key, "start", "end")
        hits = sr.outside_masks(stored(hits, "design"), hidden)  # read twice
    return sr.background_checked(guides, hits)


def designed(targets: DataFrame, design: Design, background: DataFrame | None = None, masks: DataFrame | None = None, exclude: DataFrame | None = None,
             alignment: DataFrame | None = None, features: DataFrame | None = None, ranks: DataFrame | None = None,
             approve: Callable[[int, list[str]], Sequence[str]] | None = None) -> Designed:
    """Guides of ``targets`` (target_id, seq), checked, and sets of passing ones that cover
    every target that a guide hits, passing or not; none where they cannot (see ``uncovered``).
    With ``cover_reachable`` they cover the targets that passing guides hit.

    Checks: GC content; ``exclude`` (seq); ``background`` (source, molecule, seq), in which
    the targets and ``masks`` (seq_id, seq) themselves are no off-targets; and, of hits,
    whether they lie within the features of ``alignment`` and ``features`` (see
    ``feature_check``).  A check without its table is not set and asks nothing.  ``ranks`` and
    ``approve`` as in ``exclusive_sets``.
    """
    guides, hits = candidates(targets, design)
    guides = chk.with_check(guides, "GC", lambda c: sq.gc_content(c).between(design.gc_min, design.gc_max))
    unset = F.lit(None).cast("boolean")
    guides = exclude_check(guides, exclude) if exclude is not None else guides.withColumn("exclude", unset)
    if background is not None:
        own = targets.select(F.col("target_id").alias("seq_id"), "seq")
        guides = screened(guides, background, design, own if masks is None else own.unionByName(masks.select("seq_id", "seq")))
    else:
        guides = guides.withColumn("background", unset)
    guides = stored(guides.select("grna", "grna_id", "GC", "exclude", "background"), "design")
    if alignment is not None and features is not None:
        found = feature_check(hits, alignment, features, design.max_insertion, design.min_within_n, design.min_within_fraction)
        hits = stored(hits.join(found.select("hit_id", "feature"), "hit_id", "left"), "design")
    else:
        hits = hits.withColumn("feature", unset)
    passing = [stored(df, "design") for df in chk.valid_guides(guides, hits, lenient=design.accept_unset)]
    if design.prioritise_nonredundant:
        sets = nonredundant_sets(passing[1], design.sets)
    else:
        sets = cov.exclusive_sets(passing[1], design.sets, None if design.cover_reachable else hits, design.set_cover, approve=approve, ranks=ranks)
    return Designed(guides, hits, *passing, sets)


def discovered_targets(genes: DataFrame, genomes: DataFrame, design: Design, coding: DataFrame | None = None, reference: DataFrame | None = None, annotation: DataFrame | None = None) -> DataFrame:
    """(target_id, seq): stretches of ``genomes`` (source, molecule, seq) similar to ``genes``
    (gene, seq), named ``source|molecule|number|start-end``.

    Similar places of a molecule are joined within ``merge_within`` bases and kept by length
    and identity.  ``coding`` (gene, seq): a stretch holds at least ``min_cds_length`` bases
    similar to it.  With ``check_reciprocal`` it is looked up in ``reference`` (molecule, seq)
    in turn: its best place has to lie on features (molecule, start, end, gene) of ``genes``
    alone, or of them and others (``relax_reciprocal``); a place without features passes.
    """
    subject = F.concat_ws("\0", "source", "molecule").alias("subject_id")
    place = [F.split_part("subject_id", F.lit("\0"), F.lit(1)).alias("source"), F.split_part("subject_id", F.lit("\0"), F.lit(2)).alias("molecule"), F.col("sstart").alias("start"), F.col("send").alias("end")]
    similar = lambda q: homologous_hsps(q.select(F.col("gene").alias("query_id"), "seq"), genomes.select(subject, "seq")).select(*place, F.col("ident_pct").alias("pident"))
    keys = ["source", "molecule"]
    regions = stored(sr.merged_hits(similar(genes), keys, design.merge_within, design.min_length, design.min_identity).select(*keys, "start", "end"), "targets")
    if coding is not None:
        # Merged regions are disjoint, so a piece's region is the one that holds its start.
        pieces = intersected(regions, similar(coding), keys).select(*keys, F.col("start").alias("p_start"), F.col("end").alias("p_end"))
        long = sr.overlap_all(regions, pieces.select(*keys, F.col("p_start").alias("r_start"), F.col("p_end").alias("r_end")), keys)
        long = long.groupBy(*keys, "start", "end").agg(F.sum("overlap").alias("n")).where(F.col("n") >= design.min_cds_length)
        regions = stored(long.select(*keys, "start", "end"), "targets")
    found = sq.region_sequences(regions, genomes, None).select(F.col("seq_id").alias("target_id"), "seq")
    if not design.check_reciprocal:
        return found
    if reference is None or annotation is None:
        raise ValueError("the reciprocal check needs a reference and its annotation")
    found = stored(found, "targets")
    back = homologous_hsps(found.select(F.col("target_id").alias("query_id"), "seq"), reference.select(F.col("molecule").alias("subject_id"), "seq"))
    back = back.select(F.col("query_id").alias("candidate"), F.col("subject_id").alias("molecule"), F.col("sstart").alias("start"), F.col("send").alias("end"), "bitscore")
    on = sr.overlap_all(back, annotation.select("molecule", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("gene").alias("feature")), ["molecule"])
    names = [r[0] for r in genes.select("gene").distinct().collect()]  # the genes of a design, asked for by name
    return found.join(sr.reciprocal(on, names, design.relax_reciprocal).select(F.col("candidate").alias("target_id")), "target_id", "left_semi")


def write_designed(result: Designed, folder: str, names: DataFrame | None = None) -> list[str]:
    """Maps, FASTA and equivalents of all, passing and final guides under ``folder``, and their
    paths.  Sequences of ``names`` (seq_id, seq) give guides their names."""
    checks = ["background", "GC", "exclude", "feature"]
    words = F.when(F.col("sense") == "+", "sense").when(F.col("sense") == "-", "antisense").otherwise("NA")
    final = result.sets.select("grna").distinct()
    of_sets = result.sets.groupBy("grna").agg(F.min("set_number").alias("number"))
    paths = []
    for kind, guides, hits in (
        ("all", result.guides, result.hits), ("pass", result.passing_guides, result.passing_hits),
        ("final", result.passing_guides.join(final, "grna", "left_semi"), result.passing_hits.join(final, "grna", "left_semi")),
    ):
        rows = hits.join(guides.select("grna", "grna_id", *checks[:3]), "grna").join(of_sets, "grna", "left")
        number = F.coalesce("number", F.lit(1)) if kind == "final" else F.lit(1)
        held = F.create_map(*[e for c in checks for e in (F.lit(c), F.col(c))])
        rows = rows.select("grna_id", "grna", "target_id", "target_len", words.alias("sense"), "strand", "start", "end", number.alias("set"), held.alias("checks"))
        groups = cov.collapsed(hits)
        paths += src.write_outputs(kind, folder, guides.select("grna_id", "grna"), rows, groups, cov.relative_position(hits), checks, names)
    return paths


def full(spark: SparkSession, design: Design, folder: str, targets: str | None = None, genes: str | None = None, queries: Mapping[str, str] | Sequence[str] = (),
         background: Mapping[str, str] | Sequence[str] = (), references: Mapping[str, str] | Sequence[str] = (), masks: str | None = None, exclude: str | None = None, **tables) -> Designed:
    """From files to files: targets from a FASTA file, or found as homologues of the sequences
    of ``genes`` in ``queries``; guides, checks and sets by ``design``; maps and FASTA under
    the prefix's folder in ``folder``.

    ``background`` and, with ``screen_reference``, ``references`` are screened for off-targets;
    files are given under aliases or numbered.  ``tables`` go to ``designed``.
    """
    sequences = lambda path: src.read_fasta(spark, path).select("seq_id", "seq")
    if (targets is None) == (genes is None):
        raise ValueError("give either targets or genes")
    if targets is not None:
        rows = sequences(targets).withColumnRenamed("seq_id", "target_id")
    else:
        rows = stored(discovered_targets(sequences(genes).withColumnRenamed("seq_id", "gene"), registered(spark, queries), design), "targets")
    parts = [registered(spark, f, p) for f, p in ((background, "background"), (references if design.screen_reference else (), "reference")) if f]
    screens = None
    for part in parts:
        screens = part if screens is None else screens.unionByName(part)
    result = designed(rows, design, screens, sequences(masks) if masks else None, sequences(exclude) if exclude else None, **tables)
    write_designed(result, f"{folder}/{design.prefix}")
    return result


def uncovered(result: Designed) -> DataFrame:
    """(target_id): targets that guides hit, but no passing one."""
    return result.hits.select("target_id").distinct().join(result.passing_hits.select("target_id").distinct(), "target_id", "left_anti")

