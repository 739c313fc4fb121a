"""All queries over the test tables and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.pam import Pam
from strandline.functions.patterns import off_target
from strandline.operators import alignment as aln
from strandline.operators import checks as chk
from strandline.operators import coverage as cov
from strandline.operators import domains as dom
from strandline.operators import features as ft
from strandline.operators import gapped as gap
from strandline.operators import homology as hom
from strandline.operators import ranges as rg
from strandline.operators import search as sr
from strandline.operators import sequences as sq
from strandline.operators.joins import dealt
from strandline.plans import substrate as sub
from strandline.plans.registry import ORACLES, QUERIES, big, query
from strandline.sources import text as src

# sequences -----------------------------------------------------------------------------


@query(f"WITH {sub.D_TARGETS} SELECT target_id, round((length(seq) - length(replace(replace(seq,'G',''),'C',''))) / length(seq), 6) AS gc FROM t")
def gc_content(spark, d):
    return sub.targets(spark, d).select("target_id", F.round(sq.gc_content(F.col("seq")), 6).alias("gc"))


@query(f"WITH {sub.D_TARGETS} SELECT target_id, round((length(seq) - length(replace(replace(seq,'G',''),'C',''))) / length(seq), 6) BETWEEN 0.45 AND 0.55 AS ok FROM t")
def gc_check(spark, d):
    return sub.targets(spark, d).select("target_id", F.round(sq.gc_content(F.col("seq")), 6).between(0.45, 0.55).alias("ok"))


@query(f"WITH {sub.D_TARGETS} SELECT target_id, reverse(translate(seq,'ACGT','TGCA')) AS rc FROM t")
def reverse_complement(spark, d):
    return sub.targets(spark, d).select("target_id", sq.reverse_complement(F.col("seq")).alias("rc"))


@query(f"""WITH {sub.D_TARGETS} SELECT target_id, array_to_string(list_transform(range(1, length(seq) - 1, 3), lambda i: substring('{sq.STANDARD_CODE}',
 CAST((strpos('ACGT', substring(seq, i, 1)) - 1) * 16 + (strpos('ACGT', substring(seq, i + 1, 1)) - 1) * 4 + strpos('ACGT', substring(seq, i + 2, 1)) AS INTEGER), 1)), '') AS peptide FROM t""")
def translate_cds(spark, d):
    return sub.targets(spark, d).select("target_id", sq.translated(F.col("seq")).alias("peptide"))


@query(f"WITH {sub.D_TARGETS} SELECT target_id, substring(seq, 11, 30) AS part FROM t")
def seq_slice(spark, d):
    return sub.targets(spark, d).select("target_id", F.substring("seq", 11, 30).alias("part"))


@query(f"""WITH {sub.D_TARGETS}, {sub.D_GUIDES} SELECT target_id, strand, grna, "start" FROM g""")
def grna_enumerate(spark, d):
    return sq.guides(sub.targets(spark, d), Pam.parse("NGG")).select("target_id", "strand", "grna", *big("start"))


@query(f"""WITH {sub.D_TARGETS}, {sub.D_GUIDES}, r AS (SELECT grna, min(struct_pack(a := CAST(target_id AS BIGINT), b := "start", c := strand)) AS o FROM g GROUP BY grna)
 SELECT grna, format('gRNA_{{:03d}}', row_number() OVER (ORDER BY o, grna)) AS grna_id FROM r""")
def grna_ids(spark, d):
    found = sq.guides(sub.targets(spark, d), Pam.parse("NGG")).withColumn("t", F.col("target_id").cast("long"))
    return sq.named_guides(found, ["t", "start", "strand"])


@query(f"""WITH {sub.D_TARGETS}, {sub.D_MOLECULES}, {sub.D_GUIDES}, q AS (SELECT DISTINCT grna FROM g), f AS (SELECT grna, grna AS w, '+' AS strand FROM q UNION ALL SELECT grna, reverse(translate(grna,'ACGT','TGCA')), '-' FROM q),
 x AS (SELECT molecule, seq, unnest(range(0, length(seq) - 19)) AS p FROM m) SELECT f.grna AS query, molecule, f.strand AS strand, p AS "start" FROM x JOIN f ON substring(x.seq, p + 1, 20) = f.w""")
def find_identical(spark, d):
    q = sq.guides(sub.targets(spark, d), Pam.parse("NGG")).select(F.col("grna").alias("query"))
    return sq.exact_occurrences(q, sub.molecules(spark, d), 20).select("query", "molecule", "strand", *big("start"))


@query(f"""WITH {sub.D_TARGETS}, {sub.D_MOLECULES}, {sub.D_GUIDES}, x AS (SELECT seq, unnest(range(0, length(seq) - 19)) AS p FROM m), y AS (SELECT DISTINCT substring(seq, p + 1, 20) AS w FROM x)
 SELECT DISTINCT g.grna AS grna, y.w IS NULL AND z.w IS NULL AS background FROM g LEFT JOIN y ON g.grna = y.w LEFT JOIN y z ON reverse(translate(g.grna,'ACGT','TGCA')) = z.w""")
def background_check(spark, d):
    found = sq.guides(sub.targets(spark, d), Pam.parse("NGG")).select("grna").distinct()
    bad = sq.exact_occurrences(found.withColumnRenamed("grna", "query"), sub.molecules(spark, d), 20).select(F.col("query").alias("grna"), F.lit(False).alias("x")).distinct()
    return found.join(bad, "grna", "left").select("grna", F.coalesce("x", F.lit(True)).alias("background"))


# Of five parts of a guide one at least is the same where four bases differ at most.
NEAR_GUIDES = f"""WITH {sub.D_TARGETS}, {sub.D_MOLECULES}, {sub.D_GUIDES}, q AS (SELECT DISTINCT grna FROM g), x AS (SELECT seq, unnest(range(0, length(seq) - 19)) AS p FROM m),
 y AS (SELECT substring(seq, p + 1, 20) AS w FROM x UNION SELECT reverse(translate(substring(seq, p + 1, 20),'ACGT','TGCA')) FROM x),
 qs AS (SELECT grna, k, substring(grna, k * 4 + 1, 4) AS seed FROM q, range(5) r(k)), ys AS (SELECT w, k, substring(w, k * 4 + 1, 4) AS seed FROM y, range(5) r(k))
 SELECT DISTINCT grna, w, hamming(grna, w) AS mismatches FROM qs JOIN ys USING (k, seed) WHERE hamming(grna, w) <= 4"""


def _near_guides(spark, d):
    q = sq.guides(sub.targets(spark, d), Pam.parse("NGG"))
    both = sub.molecules(spark, d).select("molecule", F.explode(F.array("seq", sq.reverse_complement(F.col("seq")))).alias("s"))
    w = sq.windows(both, ["molecule"], 20).select(sq.letters(F.col("part"), F.col("at") - F.col("lo"), F.lit(20)).alias("w"))
    return sr.hamming_hits(q, w, 20, 4, agree=3).select("grna", "w", *big("mismatches"))


@query(NEAR_GUIDES)
def offtarget_hits(spark, d):
    """All guides of the targets against the windows of both strands of the background."""
    return _near_guides(spark, d)


@query(NEAR_GUIDES)
def offtarget_guide_hits(spark, d):
    """The rows of ``offtarget_hits``, under the name that they had before."""
    return _near_guides(spark, d)


def _gapped(spark, d):
    found = gap.edit_hits(sq.guides(sub.targets(spark, d), Pam.parse("NGG")), sub.molecules(spark, d), 2)
    n = F.length("grna")
    return found.withColumn("expanded", sr.btop_expanded(F.col("btop"), F.lit(0), n, n))


@query()
def offtarget_gapped(spark, d):
    """All guides within two edits of the background, on both strands, with their alignments."""
    return _gapped(spark, d)


@query()
def background_gapped(spark, d):
    """Guides that no gapped hit speaks against: a hit does where the twelve bases before the
    motif have neither mismatch nor gap, or all have one of each at most, and the motif stands
    beside it."""
    pam = Pam.parse("NGG")
    hits = _gapped(spark, d).join(sub.molecules(spark, d), "molecule")
    ops = sr.btop_positions(F.col("expanded"))
    close = off_target("0m9-,0g9-", ops, 20) | ((F.col("mismatches") <= 1) & (F.col("gaps") <= 1))
    motif = sr.near_pam(F.col("seq"), F.col("start"), F.col("end"), F.col("strand"), F.lit(0), F.length("grna"), 20, F.lit(0), pam, 1)
    bad = hits.where(close & motif)
    return sr.background_checked(sq.guides(sub.targets(spark, d), pam).select("grna").distinct(), bad).select("grna", "background")


@query(f"WITH {sub.D_CODING}, {sub.D_GENES}, {sub.D_TARGETS} SELECT gene, string_agg(substring(seq, CAST(\"start\" % 100 + 1 AS INTEGER), CAST(\"end\" - \"start\" AS INTEGER)), '' ORDER BY \"start\", substring(seq, CAST(\"start\" % 100 + 1 AS INTEGER), CAST(\"end\" - \"start\" AS INTEGER))) AS seq FROM cd JOIN t ON t.target_id = CAST(cd.gene % 200 + 1 AS VARCHAR) GROUP BY gene")
def stitch_cds(spark, d):
    t = sub.targets(spark, d)
    parts = sub.coding(spark, d).join(t, F.col("target_id") == (F.col("gene") % 200 + 1).cast("string"))
    parts = parts.select("gene", "start", F.lit("+").alias("strand"), F.substr("seq", F.col("start") % 100 + 1, F.col("end") - F.col("start")).alias("piece"))
    return sq.joined_pieces(parts, "gene")


# ranges ---------------------------------------------------------------------------------


@query(f"""WITH {sub.D_CODING} SELECT gene, unnest(range("start", "end")) AS pos FROM cd GROUP BY gene, "start", "end" """.replace("SELECT gene, unnest", "SELECT DISTINCT gene, unnest"))
def ranges_to_pos(spark, d):
    return rg.to_positions(sub.coding(spark, d), ["gene"]).select("gene", *big("pos"))


UNION = """p AS (SELECT DISTINCT gene, unnest(range("start", "end")) AS pos FROM cd), i AS (SELECT gene, pos, pos - row_number() OVER (PARTITION BY gene ORDER BY pos) AS k FROM p)"""


@query(f"""WITH {sub.D_CODING}, {UNION} SELECT gene, min(pos) AS "start", max(pos) + 1 AS "end" FROM i GROUP BY gene, k""")
def pos_to_ranges(spark, d):
    return rg.to_ranges(rg.to_positions(sub.coding(spark, d), ["gene"]), ["gene"]).select("gene", *big("start", "end"))


@query(f"""WITH {sub.D_CODING}, {UNION} SELECT gene, min(pos) AS "start", max(pos) + 1 AS "end" FROM i GROUP BY gene, k""")
def ranges_union(spark, d):
    coding = sub.coding(spark, d)
    return rg.merged(dealt(coding, ["gene"], coding.count()), ["gene"]).select("gene", *big("start", "end"))


WINDOWS = """o AS (SELECT gene, g_start % 300 + 100 AS "start", g_start % 300 + 350 AS "end" FROM ge), q AS (SELECT DISTINCT gene, unnest(range("start", "end")) AS pos FROM o)"""


def _windows(spark, d):
    return sub.genes(spark, d).select("gene", (F.col("g_start") % 300 + 100).alias("start"), (F.col("g_start") % 300 + 350).alias("end"))


@query(f"""WITH {sub.D_CODING}, {sub.D_GENES}, {WINDOWS}, p AS (SELECT DISTINCT gene, unnest(range("start", "end")) AS pos FROM cd), x AS (SELECT gene, pos FROM p INTERSECT SELECT gene, pos FROM q),
 i AS (SELECT gene, pos, pos - row_number() OVER (PARTITION BY gene ORDER BY pos) AS k FROM x) SELECT gene, min(pos) AS "start", max(pos) + 1 AS "end" FROM i GROUP BY gene, k""")
def ranges_intersect(spark, d):
    return rg.intersected(sub.coding(spark, d), _windows(spark, d), ["gene"], 200).select("gene", *big("start", "end"))


@query(f"""WITH {sub.D_CODING}, {sub.D_GENES}, {WINDOWS}, p AS (SELECT DISTINCT gene, unnest(range("start", "end")) AS pos FROM cd), x AS (SELECT gene, pos FROM p EXCEPT SELECT gene, pos FROM q),
 i AS (SELECT gene, pos, pos - row_number() OVER (PARTITION BY gene ORDER BY pos) AS k FROM x) SELECT gene, min(pos) AS "start", max(pos) + 1 AS "end" FROM i GROUP BY gene, k""")
def ranges_subtract(spark, d):
    return rg.subtracted(sub.coding(spark, d), _windows(spark, d), ["gene"]).select("gene", *big("start", "end"))


@query(f"""WITH {sub.D_CODING} SELECT gene, "start" + 1 AS s1, "end" AS e1 FROM cd""")
def convert_range(spark, d):
    s, e = rg.converted(F.col("start"), F.col("end"), 0, False, 1, True)
    return sub.coding(spark, d).select("gene", s.cast("long").alias("s1"), e.cast("long").alias("e1"))


@query(f"""WITH {sub.D_CODING}, {sub.D_GENES} SELECT cd.gene AS gene, count(*) FILTER (WHERE "start" >= g_start AND "end" <= g_end) AS n_within FROM cd JOIN ge USING (gene) GROUP BY cd.gene""")
def range_within(spark, d):
    j = sub.coding(spark, d).join(sub.genes(spark, d), "gene")
    return j.groupBy("gene").agg(F.count_if(rg.within(F.col("start"), F.col("end"), F.col("g_start"), F.col("g_end"))).alias("n_within"))


@query(f"""WITH {sub.D_CODING}, {sub.D_GENES} SELECT cd.gene AS gene, CASE strand WHEN '-' THEN 2000 - "end" ELSE "start" END AS s, CASE strand WHEN '-' THEN 2000 - "start" ELSE "end" END AS e FROM cd JOIN ge USING (gene)""")
def range_from_genomic(spark, d):
    j = sub.coding(spark, d).join(sub.genes(spark, d), "gene")
    s, e = ft.from_genomic(F.col("start"), F.col("end"), F.lit(0), F.lit(2000), F.col("strand"))
    return j.select("gene", s.cast("long").alias("s"), e.cast("long").alias("e"))


@query(f"""WITH {sub.D_CODING}, {sub.D_GENES} SELECT cd.gene AS gene, CASE strand WHEN '-' THEN g_end - "end" ELSE g_start + "start" END AS s, CASE strand WHEN '-' THEN g_end - "start" ELSE g_start + "end" END AS e FROM cd JOIN ge USING (gene)""")
def range_to_genomic(spark, d):
    j = sub.coding(spark, d).join(sub.genes(spark, d), "gene")
    s, e = ft.to_genomic(F.col("start"), F.col("end"), F.col("g_start"), F.col("g_end"), F.col("strand"))
    return j.select("gene", s.cast("long").alias("s"), e.cast("long").alias("e"))


@query()
def domain_ranges(spark, d):
    """Places of one domain a supplier, a stretch of a target's peptide, in the frames of all targets."""
    t = sub.targets(spark, d)
    own = sub.table(spark, d, "supplier").select(F.expr("cast(s_suppkey as string)").alias("domain")).join(t, F.col("domain") == F.col("target_id"))
    matrices = own.select("domain", F.posexplode(F.split(sq.translated(F.substring("seq", 4, 60)), "")).alias("pos", "residue")).withColumn("score", F.lit(8.0))
    peptides = dom.six_frames(t)
    return dom.domain_ranges(dom.domain_hits(matrices, peptides), peptides)


@query()
def homologue_hsp(spark, d):
    """Similar stretches of all targets in all background molecules."""
    q = sub.targets(spark, d).withColumnRenamed("target_id", "query_id")
    return hom.homologous_hsps(q, sub.molecules(spark, d).withColumnRenamed("molecule", "subject_id"))


# hits and their merging --------------------------------------------------------------------


ISLANDS = """a AS (SELECT *, max("end") OVER (PARTITION BY mol ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv),
 c AS (SELECT *, sum(CASE WHEN "start" > pe + 3600 OR pe IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY mol ORDER BY "start", "end") AS k FROM a)"""


@query(f"""WITH {sub.D_INTERVALS}, {ISLANDS} SELECT mol, min("start") AS "start", max("end") AS "end", max(pident) AS max_pident, count(*) AS n_hits FROM c GROUP BY mol, k HAVING max("end") - min("start") >= 600 AND max(pident) >= 10""")
def merge_hits(spark, d):
    return sr.merged_hits(sub.intervals(spark, d), ["mol"], 3600, 600, 10.0).select("mol", "start", "end", "max_pident", "n_hits")


@query("WITH r AS (SELECT l_partkey, l_suppkey, l_extendedprice, rank() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC) AS k FROM lineitem) SELECT l_partkey AS query_id, l_suppkey AS subject_id, l_extendedprice AS bitscore FROM r WHERE k <= 3")
def topn_ties(spark, d):
    h = sub.table(spark, d, "lineitem").select(F.col("l_partkey").alias("query_id"), F.col("l_suppkey").alias("subject_id"), F.col("l_extendedprice").alias("bitscore"))
    return sr.top_with_ties(h, "query_id", "bitscore", 3)


@query("SELECT l_partkey AS query_id, l_suppkey AS subject_id, l_discount AS metric FROM lineitem WHERE l_discount >= 0.05")
def metric_threshold(spark, d):
    return sub.table(spark, d, "lineitem").where("l_discount >= 0.05").select(F.col("l_partkey").alias("query_id"), F.col("l_suppkey").alias("subject_id"), F.col("l_discount").alias("metric"))


@query(f"""WITH {sub.D_CODING}, {sub.D_GENES}, {WINDOWS} SELECT o.gene AS gene, o."start" AS "start", o."end" AS "end", coalesce(cd."start", -1) AS r_start, coalesce(cd."end", -1) AS r_end, coalesce(least(o."end", cd."end") - greatest(o."start", cd."start"), 0) AS overlap
 FROM o LEFT JOIN cd ON o.gene = cd.gene AND o."start" < cd."end" AND cd."start" < o."end" """)
def intersect_wao(spark, d):
    c = sub.coding(spark, d).select("gene", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return sr.overlap_all(_windows(spark, d), c, ["gene"], 200).na.fill(-1, ["r_start", "r_end"]).select("gene", *big("start", "end", "r_start", "r_end", "overlap"))


@query(f"""WITH {sub.D_CODING}, {sub.D_GENES}, {WINDOWS} SELECT o.gene AS gene, sum(least(o."end", cd."end") - greatest(o."start", cd."start"))::BIGINT AS cds_overlap FROM o JOIN cd ON o.gene = cd.gene AND o."start" < cd."end" AND cd."start" < o."end" GROUP BY o.gene HAVING cds_overlap >= 40""")
def min_cds_overlap(spark, d):
    c = sub.coding(spark, d).select("gene", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    per = rg.range_join(_windows(spark, d), c, ["gene"], 200).groupBy("gene").agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).cast("long").alias("cds_overlap"))
    return per.where("cds_overlap >= 40")


RECIPROCAL = """x AS (SELECT l_orderkey AS candidate, l_suppkey % 5 AS feature, l_extendedprice AS bitscore FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY candidate ORDER BY bitscore DESC) AS k FROM x)"""


def _candidates(spark, d):
    return sub.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("candidate"), F.expr("cast(l_suppkey % 5 as string)").alias("feature"), F.col("l_extendedprice").alias("bitscore"))


@query(f"WITH {RECIPROCAL} SELECT candidate FROM r WHERE k = 1 GROUP BY candidate HAVING bool_and(feature IN (0, 1))")
def reciprocal_strict(spark, d):
    return sr.reciprocal(_candidates(spark, d), ["0", "1"])


@query(f"WITH {RECIPROCAL} SELECT candidate FROM r WHERE k = 1 GROUP BY candidate HAVING bool_or(feature IN (0, 1))")
def reciprocal_relaxed(spark, d):
    return sr.reciprocal(_candidates(spark, d), ["0", "1"], relaxed=True)


BTOP = "concat(l_linenumber, 'AG', l_linenumber, '-T5C-', l_suppkey % 7 + 1)"
D_BTOP = """x AS (SELECT l_orderkey * 10 + l_linenumber AS hit_id, CAST(l_linenumber AS INTEGER) AS n, CAST(l_suppkey % 7 + 1 AS INTEGER) AS z FROM lineitem),
 b AS (SELECT hit_id, repeat('.', n) || 'm' || repeat('.', n) || 'd' || '.....' || 'i' || repeat('.', z) AS e, n, z FROM x)"""


def _btop(spark, d):
    x = sub.table(spark, d, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("hit_id"), F.expr(BTOP).alias("btop"), F.expr("cast(2 * l_linenumber + 7 + l_suppkey % 7 + 1 as int)").alias("q_end"))
    return x.select("hit_id", sr.btop_expanded(F.col("btop"), F.lit(0), F.col("q_end"), F.lit(30)).alias("expanded"))


@query(f"WITH {D_BTOP} SELECT hit_id, e || repeat(' ', 30 - (2 * n + 7 + z)) AS expanded FROM b")
def btop_expand(spark, d):
    return _btop(spark, d)


@query(f"WITH {D_BTOP} SELECT hit_id, 1 AS mismatches, 1 AS insertions, 1 AS deletions, 2 AS gaps FROM b")
def btop_counts(spark, d):
    e = F.col("expanded")
    return _btop(spark, d).select("hit_id", sr.counted(e, "m").alias("mismatches"), sr.counted(e, "i").alias("insertions"), sr.counted(e, "d").alias("deletions"), sr.counted(e, "id").alias("gaps"))


@query(f"""WITH {D_BTOP}, s AS (SELECT hit_id, regexp_extract_all(e || repeat(' ', 30 - (2 * n + 7 + z)) || '$', 'd*[.mi $]') AS l FROM b)
 SELECT hit_id, len(regexp_replace(array_to_string(l[1:5], ''), '[^m]', '', 'g')) <= 0 AND len(regexp_replace(array_to_string(l[6:30], ''), '[^id]', '', 'g')) <= 1 AS off FROM s""")
def ot_pattern_range(spark, d):
    ops = sr.btop_positions(F.col("expanded"))
    return _btop(spark, d).select("hit_id", off_target("0m1-5,1g6-", ops, 30).alias("off"))


@query(f"""SELECT l_orderkey * 10 + l_linenumber AS hit_id, l_linenumber % 3 <= 1 AND l_suppkey % 2 <= 0 AND (1 - l_linenumber % 3) + (0 - l_suppkey % 2) >= l_partkey % 2 AS off FROM lineitem""")
def offtarget_total(spark, d):
    mm, gp, al = F.expr("l_linenumber % 3"), F.expr("l_suppkey % 2"), F.expr("20 - l_partkey % 2")
    return sub.table(spark, d, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("hit_id"), sr.off_target_total(mm, gp, al, 20, 2, 1).alias("off"))


@query(f"""WITH {sub.D_HITS}, k AS (SELECT CAST(s_suppkey AS VARCHAR) AS molecule, s_suppkey * 13 % 1500 AS ms, s_suppkey * 13 % 1500 + 400 AS me FROM supplier) SELECT hit_id FROM h WHERE NOT EXISTS (SELECT 1 FROM k WHERE molecule = target_id AND "start" >= ms AND "end" <= me)""")
def offtarget_outside_mask(spark, d):
    masks = sub.table(spark, d, "supplier").select(F.expr("cast(s_suppkey as string)").alias("molecule"), F.expr("cast(s_suppkey * 13 % 1500 as int)").alias("start"), F.expr("cast(s_suppkey * 13 % 1500 + 400 as int)").alias("end"))
    return sr.outside_masks(sub.hits(spark, d).select("hit_id", F.col("target_id").alias("molecule"), "start", "end"), masks).select("hit_id")


@query("SELECT s_suppkey, s_name FROM supplier WHERE split_part(s_name, '#', -1) IN ('000000003', '000000007') OR s_suppkey IN (5)")
def domain_filter(spark, d):
    s = sub.table(spark, d, "supplier")
    return s.where(sr.in_domains(F.translate("s_name", "#", "|"), ["000000003", "000000007"]) | (F.col("s_suppkey") == 5)).select("s_suppkey", "s_name")


@query("WITH r AS (SELECT p_type, p_brand, min(p_partkey) AS rep FROM part GROUP BY ALL) SELECT rep, p_partkey FROM part JOIN r USING (p_type, p_brand)")
def nr_collapse_expand(spark, d):
    p = sub.table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_type", "p_brand").alias("seq"))
    return sr.collapsed_queries(p, "seq", "p_partkey").select("rep", "p_partkey")


# coverage and covers -------------------------------------------------------------------------


@query(f"WITH {sub.D_HITS} SELECT grna, count(DISTINCT target_id) AS n_targets, array_to_string(list_sort(list_distinct(list(target_id))), ',') AS targets FROM h GROUP BY grna")
def coverage(spark, d):
    return cov.coverage(sub.hits(spark, d)).select("grna", *big("n_targets"), F.array_join("targets", ",").alias("targets"))


@query(f"""WITH {sub.D_HITS} SELECT grna, round(avg(CASE WHEN sense = '-' THEN target_len - "end" ELSE "start" END), 6) AS pos FROM h GROUP BY grna""")
def prox_5prime(spark, d):
    return cov.relative_position(sub.hits(spark, d)).select("grna", F.round("pos", 6).alias("pos"))


D_COLLAPSE = f"""{sub.D_HITS}, c AS (SELECT grna, list_sort(list_distinct(list(target_id))) AS ts FROM h GROUP BY grna), s AS (SELECT ts, row_number() OVER (ORDER BY len(ts) DESC, ts) AS k FROM (SELECT DISTINCT ts FROM c))"""


@query(f"WITH {D_COLLAPSE} SELECT 'cg_' || lpad(CAST(k AS VARCHAR), CAST(length(CAST((SELECT max(k) FROM s) AS VARCHAR)) AS INTEGER), '0') AS cg, grna, CAST(len(c.ts) AS BIGINT) AS n_targets FROM c JOIN s ON c.ts = s.ts")
def collapse_coverage(spark, d):
    return cov.collapsed(sub.hits(spark, d)).select("cg", "grna", *big("n_targets"))


@query(f"""WITH {D_COLLAPSE}, p AS (SELECT grna, avg(CASE WHEN sense = '-' THEN target_len - "end" ELSE "start" END) AS pos FROM h GROUP BY grna)
 SELECT 'cg_' || lpad(CAST(k AS VARCHAR), CAST(length(CAST((SELECT max(k) FROM s) AS VARCHAR)) AS INTEGER), '0') AS coverage_group, CAST(len(c.ts) AS BIGINT) AS coverage, 'gRNA_' || grna AS grna_id, grna AS grna_seq, floor(pos * 100 + 0.5) / 100 AS relative_pos
 FROM c JOIN s ON c.ts = s.ts JOIN p USING (grna)""")
def eqv_export(spark, d):
    hits = sub.hits(spark, d)
    guides = hits.select(F.concat(F.lit("gRNA_"), "grna").alias("grna_id"), "grna").distinct()
    table = src.equivalents(cov.collapsed(hits), cov.relative_position(hits), guides)
    return table.withColumn("coverage", F.col("coverage").cast("long")).toDF("coverage_group", "coverage", "grna_id", "grna_seq", "relative_pos")


@query(f"""WITH {sub.D_HITS}, c AS (SELECT DISTINCT 'cg_' || target_id AS cg, grna FROM h), p AS (SELECT cg, grna, row_number() OVER (PARTITION BY cg ORDER BY CAST(grna AS BIGINT), grna) AS set_number, count(*) OVER (PARTITION BY cg) AS n FROM c)
 SELECT set_number, cg, grna FROM p WHERE set_number <= (SELECT min(n) FROM p)""")
def generate_grna_sets(spark, d):
    groups = sub.hits(spark, d).select(F.concat(F.lit("cg_"), "target_id").alias("cg"), "grna", F.col("grna").cast("long").alias("pos")).distinct()
    return cov.one_from_each_group(groups)


@query(f"WITH {sub.D_HITS} SELECT grna, count(target_id) AS listed, count(DISTINCT target_id) AS distinct_elements, count(target_id) - count(DISTINCT target_id) AS redundancy FROM h GROUP BY grna")
def redundancy(spark, d):
    return cov.redundancy(sub.hits(spark, d).withColumnRenamed("target_id", "element"), ["grna"])


# checks --------------------------------------------------------------------------------------


@query(f"WITH {sub.D_HITS} SELECT hit_id, coalesce(background, false) AND coalesce(feature, false) AS ok FROM h")
def checks_strict(spark, d):
    return sub.hits(spark, d).select("hit_id", chk.passed([F.col("background"), F.col("feature")]).alias("ok"))


@query(f"WITH {sub.D_HITS} SELECT hit_id, coalesce(background, true) AND coalesce(feature, true) AS ok FROM h")
def checks_lenient(spark, d):
    return sub.hits(spark, d).select("hit_id", chk.passed([F.col("background"), F.col("feature")], lenient=True).alias("ok"))


@query(f"WITH {sub.D_HITS} SELECT hit_id FROM h WHERE coalesce(background, false) AND coalesce(feature, false)")
def filter_hits(spark, d):
    return chk.filtered(sub.hits(spark, d), ["background", "feature", "extra", "unknown"]).select("hit_id")


@query(f"WITH {sub.D_HITS} SELECT hit_id FROM h WHERE coalesce(background, true) AND coalesce(feature, true)")
def filter_seqs(spark, d):
    return chk.filtered(sub.hits(spark, d), ["background", "feature", "extra"], lenient=True).select("hit_id")


@query(f"""WITH {sub.D_HITS} SELECT 'background' AS "check", count(background) AS n_set, count(*) - count(background) AS n_unset, count(*) FILTER (WHERE NOT background) AS n_fail FROM h UNION ALL SELECT 'feature', count(feature), count(*) - count(feature), count(*) FILTER (WHERE NOT feature) FROM h
 UNION ALL SELECT 'extra', 0, count(*), 0 FROM h""")
def check_status_report(spark, d):
    return chk.status(sub.hits(spark, d), ["background", "feature", "extra"])


@query(f"WITH {sub.D_HITS} SELECT hit_id, CASE WHEN background THEN 'pass' WHEN NOT background THEN 'fail' ELSE 'NA' END AS text FROM h")
def check_encode(spark, d):
    return sub.hits(spark, d).select("hit_id", chk.decoded(chk.encoded(chk.decoded(F.col("background")))).alias("text"))


# features and sources --------------------------------------------------------------------------


@query("""WITH x AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)
 SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id, 0 AS level FROM region UNION ALL SELECT parent, id, 1 FROM x WHERE id LIKE 'n%' UNION ALL SELECT y.parent, x.id, 2 FROM x JOIN x y ON x.parent = y.id""")
def feature_closure(spark, d):
    n = sub.table(spark, d, "nation").select(F.expr("concat('n', n_nationkey)").alias("id"), F.expr("array(concat('r', n_regionkey))").alias("parents"))
    c = sub.table(spark, d, "customer").select(F.expr("concat('c', c_custkey)").alias("id"), F.expr("array(concat('n', c_nationkey))").alias("parents"))
    return ft.closure(n.unionByName(c), sub.table(spark, d, "region").select(F.expr("concat('r', r_regionkey)").alias("id")))


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def subfeatures(spark, d):
    c = sub.table(spark, d, "customer").select(F.expr("concat('c', c_custkey)").alias("id"), F.expr("array(concat('n', c_nationkey))").alias("parents"))
    ids = sub.table(spark, d, "nation").where("n_regionkey = 1").select(F.expr("concat('n', n_nationkey)").alias("id"))
    return ft.subfeatures(c, ids).select("id")


@query(f"""WITH {sub.D_CODING} SELECT gene, min("start") AS "start", max("end") AS "end", count(*) AS parts FROM cd GROUP BY gene""")
def feature_span(spark, d):
    return sub.coding(spark, d).groupBy("gene").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.count(F.lit(1)).alias("parts"))


@query(f"""WITH {sub.D_CODING} SELECT gene, "start", coalesce(sum("end" - "start") OVER (PARTITION BY gene ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT % 3 AS phase FROM cd""")
def cds_phase(spark, d):
    return ft.coding_phase(sub.coding(spark, d), "gene").select("gene", *big("start", "phase"))


@query(f"""WITH {sub.D_CODING}, x AS (SELECT gene, "start", "end", coalesce(sum("end" - "start") OVER (PARTITION BY gene ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM cd) SELECT gene, "start", a AS part_start, a + "end" - "start" AS part_end FROM x""")
def adj_feature_range(spark, d):
    return ft.stitched_ranges(sub.coding(spark, d), "gene").select("gene", *big("start", "part_start", "part_end"))


@query("""WITH x AS (SELECT s_suppkey, 'ID=s' || s_suppkey || ';Parent=n' || s_nationkey || ',r' || s_suppkey % 3 AS a FROM supplier), y AS (SELECT s_suppkey, unnest(string_split(a, ';')) AS kv FROM x)
 SELECT s_suppkey, split_part(kv, '=', 1) AS name, split_part(kv, '=', 2) AS vals FROM y""")
def gff_attributes(spark, d):
    x = sub.table(spark, d, "supplier").select("s_suppkey", F.expr("concat('ID=s', s_suppkey, ';Parent=n', s_nationkey, ',r', s_suppkey % 3)").alias("attrs"))
    return ft.attributes(x, ["s_suppkey"]).select("s_suppkey", "name", F.array_join("values", ",").alias("vals"))


@query("""SELECT 'chr' || l_suppkey AS seqid, 'CDS' AS type, l_partkey + 9 AS "start", l_partkey + 40 AS "end", CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_quantity END AS score, CAST(l_linenumber % 3 AS BIGINT) AS phase, 'ID=x' || l_orderkey AS attrs FROM lineitem""")
def gff_parse(spark, d):
    line = "concat_ws('\t', concat('chr', l_suppkey), 'src', 'CDS', l_partkey + 10, l_partkey + 40, case when l_linestatus = 'O' then '.' else cast(l_quantity as string) end, '+', l_linenumber % 3, concat('ID=x', l_orderkey))"
    return src.parsed_gff(sub.table(spark, d, "lineitem").select(F.expr(line).alias("value"))).select("seqid", "type", *big("start", "end"), "score", *big("phase"), "attrs")


@query("""SELECT concat_ws(chr(9), 'chr' || l_suppkey, 'src', 'CDS', CAST(l_partkey + 1 AS VARCHAR), CAST(l_partkey + 31 AS VARCHAR), '.', '+', CAST(l_linenumber % 3 AS VARCHAR), 'ID=x' || l_orderkey) AS line FROM lineitem""")
def gff_render(spark, d):
    t = sub.table(spark, d, "lineitem")
    return t.select(src.gff_line(F.expr("concat('chr', l_suppkey)"), F.lit("src"), F.lit("CDS"), F.col("l_partkey"), F.expr("l_partkey + 31"), F.lit(None), F.lit("+"), F.expr("l_linenumber % 3"), F.expr("concat('ID=x', l_orderkey)")).alias("line"))


@query("WITH x AS (SELECT n_name AS a, n_nationkey AS value FROM nation UNION ALL SELECT 'alias_' || n_nationkey, n_nationkey FROM nation) SELECT a AS alias, value FROM x")
def alias_lookup(spark, d):
    n = sub.table(spark, d, "nation").select(F.concat_ws(";", "n_name", F.expr("concat('alias_', n_nationkey)")).alias("keys"), "n_nationkey")
    return src.lookup(n, "keys", "n_nationkey")


@query("SELECT n_regionkey AS value, array_to_string(list_sort(list(n_name)), ',') AS aliases FROM nation GROUP BY n_regionkey")
def alias_inverse(spark, d):
    n = sub.table(spark, d, "nation").select(F.col("n_regionkey").alias("value"), F.col("n_name").alias("alias"))
    return src.inverse_lookup(n).select("value", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT lang, min(doc_id) AS first_line, row_number() OVER (ORDER BY min(doc_id), lang) - 1 AS \"index\" FROM documents GROUP BY lang")
def seqid_order(spark, d):
    return ft.appearance_order(sub.table(spark, d, "documents"), "lang", "doc_id").select("lang", "first_line", *big("index"))


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand")
def value_counts(spark, d):
    return sub.table(spark, d, "part").groupBy(F.col("p_brand").alias("value")).agg(F.count(F.lit(1)).alias("n"))


# alignments ------------------------------------------------------------------------------------


GAPPED = "translate(md5(concat('a', {k})),'0123456789abcdef','ACGTACGTACGTAC--')"


def _alignment(spark, d):
    return sub.table(spark, d, "part").select("p_partkey", F.expr(GAPPED.format(k="p_partkey")).alias("aln"))


@query(f"WITH a AS (SELECT p_partkey, {GAPPED.format(k='p_partkey')} AS aln FROM part), c AS (SELECT p_partkey, aln, unnest(range(1, 33)) AS i FROM a), b AS (SELECT p_partkey, i - 1 AS col, row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS pos FROM c WHERE substring(aln, i, 1) <> '-') SELECT p_partkey, col FROM b WHERE pos = 10")
def adjusted_pos(spark, d):
    return _alignment(spark, d).select("p_partkey", aln.gapped_position(F.col("aln"), F.lit(10)).cast("long").alias("col")).where("col is not null")


@query(f"""WITH a AS (SELECT p_partkey, {GAPPED.format(k='p_partkey')} AS aln FROM part), c AS (SELECT p_partkey, aln, unnest(range(1, 33)) AS i FROM a), b AS (SELECT p_partkey, i - 1 AS col, i - row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS k FROM c WHERE substring(aln, i, 1) <> '-')
 SELECT p_partkey, min(col) AS "start", max(col) + 1 AS "end" FROM b GROUP BY p_partkey, k""")
def adjusted_ranges(spark, d):
    return aln.base_ranges(_alignment(spark, d), ["p_partkey"]).select("p_partkey", *big("start", "end"))


@query(f"""WITH {sub.D_HITS}, r AS (SELECT CAST(s_suppkey AS VARCHAR) AS target_id, s_nationkey AS gene, s_suppkey * 7 % 900 AS rs, s_suppkey * 7 % 900 + 700 AS re FROM supplier)
 SELECT hit_id, count(DISTINCT gene) FILTER (WHERE "start" >= rs AND "end" <= re) AS n_within, count(*) FILTER (WHERE "start" >= rs AND "end" <= re) >= 1 AS feature FROM h JOIN r USING (target_id) GROUP BY hit_id""")
def within_feature(spark, d):
    r = sub.table(spark, d, "supplier").select(F.expr("cast(s_suppkey as string)").alias("target_id"), F.col("s_nationkey").alias("gene"), F.expr("s_suppkey * 7 % 900").alias("r_start"), F.expr("s_suppkey * 7 % 900 + 700").alias("r_end"))
    return aln.within_features(sub.hits(spark, d).select("hit_id", "target_id", "start", "end"), r, 1, 0.0)


# the other catalogs register theirs
from strandline.plans import catalog_design, catalog_features, catalog_selection  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "catalog_design", "catalog_features", "catalog_selection"]
