"""Queries of look-ups, checks, off-target and feature tests and covers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.pam import Pam
from strandline.functions.patterns import off_target
from strandline.operators import alignment as aln
from strandline.operators import checks as chk
from strandline.operators import coverage as cov
from strandline.operators import covers as cvs
from strandline.operators import msa
from strandline.operators import records as rec
from strandline.operators import search as sr
from strandline.operators import sequences as sq
from strandline.operators import targets as tg
from strandline.operators.joins import merged_in_joins, spread
from strandline.operators.scratch import stored
from strandline.plans import substrate as sub
from strandline.plans.registry import big, query
from strandline.sources import text as src

# look-ups and set algebra ------------------------------------------------------------------


@query(f"WITH {sub.D_HITS} SELECT hit_id, 'g' || p_partkey AS grna_id FROM h JOIN part ON grna = CAST(p_partkey AS VARCHAR) WHERE p_size > 20")
def hits_join(spark, d):
    guides = sub.table(spark, d, "part").where("p_size > 20").select(F.expr("cast(p_partkey as string)").alias("grna"), F.expr("concat('g', p_partkey)").alias("grna_id"))
    return rec.hits_of(guides, sub.hits(spark, d)).select("hit_id", "grna_id")


@query("SELECT p_brand AS grna_id, min(CAST(p_partkey AS VARCHAR)) AS grna, count(*) AS n FROM part WHERE p_brand IN (SELECT 'Brand#' || s_suppkey % 60 FROM supplier) GROUP BY p_brand")
def grna_by_id(spark, d):
    guides = sub.table(spark, d, "part").select(F.col("p_brand").alias("grna_id"), F.expr("cast(p_partkey as string)").alias("grna"))
    return rec.by_id(guides, sub.table(spark, d, "supplier").select(F.expr("concat('Brand#', s_suppkey % 60)").alias("grna_id")))


D_FASTA = f"{sub.D_TARGETS}, g AS (SELECT DISTINCT substring(seq, 1, 20) AS grna, 'old_' || target_id AS grna_id, CAST(target_id AS BIGINT) AS k FROM t), n AS (SELECT lower(grna) AS seq, 'new_' || k AS seq_id FROM g WHERE k % 3 = 0)"


def _fasta(spark, d):
    t = sub.targets(spark, d).select(F.substring("seq", 1, 20).alias("grna"), F.concat(F.lit("old_"), "target_id").alias("grna_id"), F.col("target_id").cast("long").alias("k"))
    return t, t.where("k % 3 = 0").select(F.lower("grna").alias("seq"), F.concat(F.lit("new_"), F.col("k").cast("string")).alias("seq_id"))


@query(f"WITH {D_FASTA} SELECT coalesce(seq_id, grna_id) AS grna_id, grna FROM g LEFT JOIN n ON grna = upper(seq)")
def rename_left_join(spark, d):
    guides, names = _fasta(spark, d)
    return src.named_guides(guides, names).select("grna_id", "grna")


@query(f"WITH {D_FASTA} SELECT grna, grna_id FROM g WHERE grna IN (SELECT upper(seq) FROM n)")
def semi_join(spark, d):
    guides, names = _fasta(spark, d)
    return tg.in_sequences(guides, names).select("grna", "grna_id")


@query(f"WITH {D_FASTA} SELECT grna, grna_id FROM g WHERE grna NOT IN (SELECT upper(seq) FROM n)")
def anti_join(spark, d):
    guides, names = _fasta(spark, d)
    return tg.in_sequences(guides, names, keep=False).select("grna", "grna_id")


@query(f"WITH {D_FASTA} SELECT grna, grna NOT IN (SELECT upper(seq) FROM n) AS exclude FROM g")
def exclude_check(spark, d):
    guides, names = _fasta(spark, d)
    return tg.exclude_check(guides, names).select("grna", "exclude")


@query("WITH x AS (SELECT p_partkey, translate(substring(md5(CAST(p_partkey AS VARCHAR)), 1, 16), '0123456789abcdef', 'ACGTUacgtuACGTNR') AS seq FROM part) SELECT p_partkey, seq, NOT contains(seq, 'N') AND NOT contains(seq, 'R') AS plain FROM x")
def unambiguous(spark, d):
    x = sub.table(spark, d, "part").select("p_partkey", F.expr("translate(substring(md5(cast(p_partkey as string)), 1, 16), '0123456789abcdef', 'ACGTUacgtuACGTNR')").alias("seq"))
    return x.select("p_partkey", "seq", tg.unambiguous(F.col("seq")).alias("plain"))


@query("SELECT o_orderkey, len(list_intersect([o_orderkey % 5, o_custkey % 5], [1, 2])) > 0 AS overlap FROM orders")
def arrays_overlap(spark, d):
    return sub.table(spark, d, "orders").select("o_orderkey", F.expr("arrays_overlap(array(o_orderkey % 5, o_custkey % 5), array(1L, 2L))").alias("overlap"))


SET_SIDES = "a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber > 2)"


@query(f"WITH {SET_SIDES} SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersection', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'difference', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'symmetric_difference', k FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION (SELECT k FROM b EXCEPT SELECT k FROM a))")
def set_ops(spark, d):
    t = sub.table(spark, d, "lineitem")
    found = rec.set_algebra(t.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")), t.where("l_linestatus = 'O' and l_linenumber > 2").select(F.col("l_partkey").alias("k")))
    parts = [rows.select(F.lit(op).alias("op"), "k") for op, rows in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT s_nationkey || '.fa' AS fname, arg_min(s_name, s_suppkey) AS alias FROM supplier GROUP BY s_nationkey")
def query_dedupe(spark, d):
    return rec.first_sources(sub.table(spark, d, "supplier").select(F.expr("concat(s_nationkey, '.fa')").alias("fname"), F.col("s_name").alias("alias"), F.col("s_suppkey").alias("ord"))).select("fname", "alias")


@query("SELECT 'guide' AS kind, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_size > 10 UNION ALL SELECT 'hit', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND p_size > 10")
def prune_records(spark, d):
    a, b = rec.pruned(sub.table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("k")), sub.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"), F.expr("l_orderkey * 10 + l_linenumber").alias("hit")), "k")
    return a.select(F.lit("guide").alias("kind"), F.col("k").cast("string").alias("id")).unionByName(b.select(F.lit("hit").alias("kind"), F.col("hit").cast("string").alias("id")))


@query("""WITH g AS (SELECT DISTINCT p_brand AS cg, p_partkey AS grna FROM part), gone AS (SELECT DISTINCT l_partkey AS grna FROM lineitem WHERE l_quantity > 10) SELECT cg, count(*) AS members FROM g WHERE grna NOT IN (SELECT grna FROM gone) GROUP BY cg""")
def remove_empty_groups(spark, d):
    groups = sub.table(spark, d, "part").select(F.col("p_brand").alias("cg"), F.col("p_partkey").alias("grna")).distinct()
    gone = sub.table(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_partkey").alias("grna"))
    return rec.without_members(groups, gone).groupBy("cg").agg(F.count(F.lit(1)).alias("members"))


@query("""WITH m AS (SELECT 'g' || c_custkey AS gene FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION SELECT 'g' || o_custkey FROM orders WHERE o_orderpriority LIKE '1%'), u AS (SELECT 'g' || c_custkey AS gene FROM customer WHERE c_nationkey = 3)
 SELECT 'mask' AS kind, gene FROM m UNION ALL SELECT 'unmask', gene FROM u WHERE gene NOT IN (SELECT gene FROM m)""")
def mask_gene_sets(spark, d):
    c, n = sub.table(spark, d, "customer"), sub.table(spark, d, "nation")
    gene, none = F.expr("concat('g', c_custkey)").alias("gene"), F.lit(None).cast("string")
    clusters = c.select(F.expr("concat('n', c_nationkey)").alias("cluster"), gene)
    asked = sub.table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.expr("concat('g', o_custkey)").alias("gene"))
    mask = n.where("n_regionkey = 1").select(none.alias("gene"), F.expr("concat('n', n_nationkey)").alias("cluster")).union(spark.createDataFrame([(".", None)], "gene string, cluster string"))
    unmask = spark.createDataFrame([(None, "n3")], "gene string, cluster string")
    return rec.mask_gene_sets(mask, unmask, asked, clusters, priority="mask")


@query(f"""WITH {sub.D_HITS} SELECT 'g' || grna AS "gRNA id", grna AS "gRNA sequence", target_id AS "target id", target_len AS "target length", sense AS "target sense", '+' AS "gRNA strand", "start" + 1 AS "start", "end", CAST(NULL AS VARCHAR) AS "set", CASE WHEN background THEN 'pass' WHEN NOT background THEN 'fail' ELSE 'NA' END AS background FROM h""")
def map_export(spark, d):
    hits = sub.hits(spark, d).select(F.concat(F.lit("g"), "grna").alias("grna_id"), "grna", "target_id", *big("target_len"), "sense", F.lit("+").alias("strand"), *big("start", "end"), F.lit(None).cast("string").alias("set"), F.create_map(F.lit("background"), "background").alias("checks"))
    return src.map_rows(hits, ["background"])


# checks -------------------------------------------------------------------------------------

D_GUIDE_CHECKS = f"""{sub.D_HITS}, gd AS (SELECT CAST(p_partkey AS VARCHAR) AS grna, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS background, p_size % 7 < 5 AS "GC", CAST(NULL AS BOOLEAN) AS exclude FROM part),
 hh AS (SELECT hit_id, grna, target_id, "start", "end", sense, target_len, feature, background AS own FROM h)"""


def _checked(spark, d):
    guides = sub.table(spark, d, "part").select(F.expr("cast(p_partkey as string)").alias("grna"), F.expr("case p_size % 3 when 0 then true when 1 then false end").alias("background"), F.expr("p_size % 7 < 5").alias("GC"), F.lit(None).cast("boolean").alias("exclude"))
    return guides, sub.hits(spark, d).withColumnRenamed("background", "own").drop("extra")


@query(f"WITH {D_GUIDE_CHECKS} SELECT gd.grna AS grna, count(*) AS n FROM gd JOIN hh USING (grna) WHERE coalesce(feature, false) AND coalesce(own, false) GROUP BY gd.grna")
def filter_hits_guides(spark, d):
    guides, hits = chk.filtered_hits(*_checked(spark, d), ["feature", "own", "no such check"])
    return guides.join(hits.select("grna", "hit_id"), "grna").groupBy("grna").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {D_GUIDE_CHECKS} SELECT grna FROM gd WHERE coalesce(background, true) AND coalesce(\"GC\", true)")
def filter_guides(spark, d):
    return chk.filtered_guides(*_checked(spark, d), ["background", "GC", "exclude"])[0].select("grna")


VALID = """v AS (SELECT gd.grna AS grna, hit_id, target_id, "start", "end", sense, target_len FROM gd JOIN hh USING (grna) WHERE coalesce(background, false) AND coalesce("GC", false) AND coalesce(feature, false) AND coalesce(own, false))"""


@query(f"WITH {D_GUIDE_CHECKS}, {VALID} SELECT grna, hit_id FROM v")
def valid_grna(spark, d):
    guides, hits = chk.valid_guides(*_checked(spark, d))
    return hits.join(guides.select("grna"), "grna", "left_semi").select("grna", "hit_id")


@query(f"WITH {sub.D_HITS} SELECT 'background' AS \"check\", count(background) > 0 AS valid, count(background) > 0 AND count(background) < count(*) AS partly FROM h UNION ALL SELECT 'feature', count(feature) > 0, count(feature) > 0 AND count(feature) < count(*) FROM h UNION ALL SELECT 'extra', false, false FROM (SELECT 1)")
def check_validity(spark, d):
    return chk.validity(sub.hits(spark, d), ["background", "feature", "extra"])


@query("SELECT 'all' AS \"check\", true AS everywhere UNION ALL SELECT 'flag_' || l_returnflag, false FROM lineitem GROUP BY l_returnflag")
def check_names(spark, d):
    m = sub.table(spark, d, "lineitem").select(F.create_map(F.lit("all"), F.lit(True), F.concat(F.lit("flag_"), "l_returnflag"), F.lit(None).cast("boolean")).alias("checks"))
    return chk.check_names(m)


@query(f"WITH {sub.D_TARGETS}, {sub.D_GUIDES} SELECT DISTINCT grna, NOT contains(grna, 'TTTT') AS no_terminator FROM g")
def check_by_function(spark, d):
    guides = sq.guides(sub.targets(spark, d), Pam.parse("NGG")).select("grna").distinct()
    return chk.with_check(guides, "no_terminator", lambda grna: ~F.contains(grna, F.lit("TTTT")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS grna, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3) THEN false WHEN p_size < 20 THEN true END AS own, CAST(NULL AS BOOLEAN) AS cleared FROM part")
def check_set_clear(spark, d):
    rows = sub.table(spark, d, "part").select(F.expr("cast(p_partkey as string)").alias("grna"), F.expr("case when p_size < 20 then true end").alias("own"), F.lit(True).alias("cleared"))
    bad = sub.table(spark, d, "lineitem").where("l_quantity < 3").select(F.expr("cast(l_partkey as string)").alias("grna"))
    return chk.cleared(chk.with_check_for(rows, "own", bad, False), ["cleared"])


# off-target ---------------------------------------------------------------------------------


@query(f"""WITH {sub.D_TARGETS}, {sub.D_MOLECULES}, q AS (SELECT 'm' || target_id AS masked, substring(seq, 1, 30 + CAST(target_id AS INTEGER) % 40) AS f FROM t), f AS (SELECT masked, f FROM q UNION SELECT masked, reverse(translate(f,'ACGT','TGCA')) FROM q),
 x AS (SELECT molecule, seq, unnest(range(0, length(seq) - 29)) AS p FROM m), w AS (SELECT molecule, seq, p, substring(seq, p + 1, 30) AS k FROM x) SELECT molecule, p AS "start", p + length(f) AS "end", masked FROM w JOIN f ON k = substring(f, 1, 30) AND substring(seq, p + 1, length(f)) = f""")
def mask_identical(spark, d):
    masks = sub.targets(spark, d).select(F.concat(F.lit("m"), "target_id").alias("seq_id"), F.expr("substring(seq, 1, 30 + cast(target_id as int) % 40)").alias("seq"))
    found = sr.masked_regions(masks, sub.molecules(spark, d).select(F.lit("file").alias("source"), "molecule", "seq"))
    return found.select("molecule", *big("start", "end"), "masked")


HSPS = """hs AS (SELECT l_orderkey * 10 + l_linenumber AS hit_id, CAST(l_partkey AS VARCHAR) AS grna, CAST(l_suppkey AS VARCHAR) AS molecule, 30 + l_orderkey % 60 AS "start", 50 + l_orderkey % 60 - l_linenumber % 3 AS "end", CASE WHEN l_linestatus = 'O' THEN '-' ELSE '+' END AS strand,
 l_linenumber % 3 AS q_start, CAST(20 AS BIGINT) AS q_end, l_quantity::BIGINT % 3 AS mismatches, l_partkey % 2 AS gaps FROM lineitem)"""


def _hsps(spark, d):
    t = sub.table(spark, d, "lineitem")
    return t.select(F.expr("l_orderkey * 10 + l_linenumber").alias("hit_id"), F.expr("cast(l_partkey as string)").alias("grna"), F.expr("cast(l_suppkey as string)").alias("molecule"), F.expr("cast(30 + l_orderkey % 60 as int)").alias("start"), F.expr("cast(50 + l_orderkey % 60 - l_linenumber % 3 as int)").alias("end"),
        F.expr("case when l_linestatus = 'O' then '-' else '+' end").alias("strand"), F.expr("cast(l_linenumber % 3 as int)").alias("q_start"), F.lit(20).alias("q_end"), F.expr("cast(cast(l_quantity as long) % 3 as int)").alias("mismatches"), F.expr("cast(l_partkey % 2 as int)").alias("gaps"))


#: Motif N-G-G after the guide, two gaps allowed: the window after a hit has 3 + (1 - gaps) bases.
D_PAM = f"""{sub.D_MOLECULES}, {HSPS}, pm AS (SELECT hs.*, CASE strand WHEN '+' THEN substring(seq, "end" + 1, 4 - gaps) ELSE reverse(translate(substring(seq, greatest("start" - (4 - gaps), 0) + 1, least("start", 4 - gaps)),'ACGT','TGCA')) END AS post FROM hs JOIN m USING (molecule)),
 pf AS (SELECT *, regexp_matches(post, '[ACGT]GG') AS pam, mismatches <= 2 AND gaps <= 1 AND (2 - mismatches) + (1 - gaps) >= 20 - (q_end - q_start) AS close FROM pm)"""


def _tested(spark, d):
    rows = _hsps(spark, d).join(sub.molecules(spark, d), "molecule")
    c = {n: F.col(n) for n in ("seq", "start", "end", "strand", "q_start", "q_end", "gaps", "mismatches")}
    pam = sr.near_pam(c["seq"], c["start"], c["end"], c["strand"], c["q_start"], c["q_end"], 20, c["gaps"], Pam.parse("NGG"), 2)
    close = sr.off_target_total(c["mismatches"], c["gaps"], c["q_end"] - c["q_start"], 20, 3, 2)
    return rows.select("hit_id", "grna", "molecule", "start", "end", pam.alias("pam"), close.alias("close"))


@query(f"WITH {D_PAM} SELECT hit_id, pam FROM pf")
def offtarget_pam(spark, d):
    return _tested(spark, d).select("hit_id", "pam")


D_FULL = f"""{D_PAM}, k AS (SELECT CAST(s_suppkey AS VARCHAR) AS molecule, s_suppkey * 13 % 60 + 20 AS ms, s_suppkey * 13 % 60 + 60 AS me FROM supplier), bad AS (SELECT hit_id, grna FROM pf WHERE close AND pam AND NOT EXISTS (SELECT 1 FROM k WHERE k.molecule = pf.molecule AND "start" >= ms AND "end" <= me))"""


def _problematic(spark, d):
    masks = sub.table(spark, d, "supplier").select(F.expr("cast(s_suppkey as string)").alias("molecule"), F.expr("cast(s_suppkey * 13 % 60 + 20 as int)").alias("start"), F.expr("cast(s_suppkey * 13 % 60 + 60 as int)").alias("end"))
    return sr.problematic_hits(_tested(spark, d), masks, F.col("close"), F.col("pam"))


@query(f"WITH {D_FULL} SELECT hit_id FROM bad")
def offtarget_full(spark, d):
    return _problematic(spark, d).select("hit_id")


@query(f"WITH {D_FULL} SELECT CAST(p_partkey AS VARCHAR) AS grna, CAST(p_partkey AS VARCHAR) NOT IN (SELECT grna FROM bad) AS background FROM part")
def background_full(spark, d):
    guides = sub.table(spark, d, "part").select(F.expr("cast(p_partkey as string)").alias("grna"))
    return sr.background_checked(guides, _problematic(spark, d)).select("grna", "background")


SHAPES = """CASE l_linenumber % 4 WHEN 0 THEN l_suppkey % 5 + 1 || '-TAG' || l_partkey % 6 + 2 WHEN 1 THEN 'A-' || l_suppkey % 7 + 3 || '-G-C' || l_partkey % 4 + 1 || 'TC' WHEN 2 THEN l_suppkey % 9 + 9 || '' ELSE 'AGTC' || l_partkey % 5 + 2 || '-A' || l_suppkey % 3 + 1 || 'C-' END"""
BODIES = """CASE l_linenumber % 4 WHEN 0 THEN repeat('.', l_suppkey % 5 + 1) || 'dm' || repeat('.', l_partkey % 6 + 2) WHEN 1 THEN 'i' || repeat('.', l_suppkey % 7 + 3) || 'dd' || repeat('.', l_partkey % 4 + 1) || 'm' WHEN 2 THEN repeat('.', l_suppkey % 9 + 9) ELSE 'mm' || repeat('.', l_partkey % 5 + 2) || 'd' || repeat('.', l_suppkey % 3 + 1) || 'i' END"""
D_SHAPES = f"""b AS (SELECT l_orderkey * 10 + l_linenumber AS hit_id, {BODIES.replace("repeat('.', ", "repeat('.', CAST(").replace(" + 1)", " + 1 AS INTEGER))").replace(" + 2)", " + 2 AS INTEGER))").replace(" + 3)", " + 3 AS INTEGER))").replace(" + 9)", " + 9 AS INTEGER))")} AS body FROM lineitem),
 e AS (SELECT hit_id, body || repeat(' ', 20 - length(replace(body, 'd', ''))) AS x FROM b)"""


def _shapes(spark, d):
    btop = SHAPES.replace(" || ", ", ").replace("THEN ", "THEN concat(").replace(" WHEN", ") WHEN").replace("linenumber % 4) WHEN", "linenumber % 4 WHEN").replace(" ELSE ", ") ELSE concat(").replace(" END", ") END")
    rows = sub.table(spark, d, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("hit_id"), F.expr(btop).alias("btop"))
    # The columns are written once; blanks for what is left of 20 query bases come after them.
    rows = rows.select("hit_id", sr.btop_expanded(F.col("btop"), F.lit(0), F.lit(0), F.lit(0)).alias("body"))
    end = F.length(F.replace("body", F.lit("d"), F.lit("")))
    return rows.select("hit_id", F.concat("body", F.repeat(F.lit(" "), 20 - end)).alias("x"))


@query(f"WITH {D_SHAPES} SELECT hit_id, x, array_to_string(regexp_extract_all(x || '$', 'd*[.mi $]'), '|') AS ahead, array_to_string(regexp_extract_all(x, '[.mi ]d*'), '|') AS back, length(regexp_replace(x, '[^m]', '', 'g')) AS mismatches, length(regexp_replace(x, '[^i]', '', 'g')) AS insertions, length(regexp_replace(x, '[^d]', '', 'g')) AS deletions FROM e")
def btop_tuple(spark, d):
    x = F.col("x")
    return _shapes(spark, d).select("hit_id", "x", F.array_join(sr.btop_positions(x), "|").alias("ahead"), F.array_join(sr.btop_positions(x, from_end=True), "|").alias("back"), *[sr.counted(x, c).cast("long").alias(n) for c, n in (("m", "mismatches"), ("i", "insertions"), ("d", "deletions"))])


@query(f"""WITH {D_SHAPES}, l AS (SELECT hit_id, regexp_extract_all(x || '$', 'd*[.mi $]') AS a, regexp_extract_all(x, '[.mi ]d*') AS b FROM e), n AS (SELECT hit_id, len(regexp_replace(array_to_string(a[1:5], ''), '[^m]', '', 'g')) <= 0 AS c1, len(regexp_replace(array_to_string(b[16:20], ''), '[^id]', '', 'g')) <= 1 AS c2,
 len(regexp_replace(array_to_string(a[3:20], ''), '[^d]', '', 'g')) <= 1 AS c3, len(regexp_replace(array_to_string(b[1:13], ''), '[^i]', '', 'g')) <= 0 AS c4, len(regexp_replace(array_to_string(b[9:17], ''), '[^mid]', '', 'g')) <= 0 AS c5 FROM l) SELECT hit_id, (c1 AND c2) AS near, ((c3 OR c4) AND c5) AS far FROM n""")
def ot_pattern_forms(spark, d):
    x = F.col("x")
    ahead, back = sr.btop_positions(x), sr.btop_positions(x, from_end=True)
    return _shapes(spark, d).select("hit_id", off_target("0m5,1g-5", ahead, 20, back).alias("near"), off_target("(1d3-|0i-8-),0mg-4--12", ahead, 20, back).alias("far"))


# feature checks of an alignment ----------------------------------------------------------------

ROW = "translate(substring(concat(md5(concat('{c}', {k})), md5(concat('{c}x', {k}))), 1, 48),'0123456789abcdef','ACGTACGTACGTAC--')"


def _aligned(spark, d):
    """Two reference genes and a target, turned round for every third part, in each alignment."""
    p = merged_in_joins(spread(sub.table(spark, d, "part").select("p_partkey"), "p_partkey"))
    row = lambda c: F.expr(ROW.format(c=c, k="p_partkey"))
    ids = F.array(F.struct(F.expr("concat('geneA', p_partkey)").alias("seq_id"), row("a").alias("aln")), F.struct(F.expr("concat('geneB', p_partkey)").alias("seq_id"), row("b").alias("aln")), F.struct(F.expr("concat(case when p_partkey % 3 = 0 then '_R_' else '' end, 't', p_partkey)").alias("seq_id"), row("c").alias("aln")))
    alignment = p.select(F.col("p_partkey").alias("aln_id"), F.explode(ids).alias("x")).select("aln_id", "x.*")
    spans = F.expr("array(named_struct('seq_id', concat('geneA', p_partkey), 'start', 3, 'end', 15), named_struct('seq_id', concat('geneA', p_partkey), 'start', 20, 'end', 30), named_struct('seq_id', concat('geneB', p_partkey), 'start', 5, 'end', 28))")
    features = p.select(F.col("p_partkey").alias("aln_id"), F.explode(spans).alias("x")).select("aln_id", "x.*")
    hits = p.select(F.col("p_partkey").alias("hit_id"), F.expr("concat('t', p_partkey)").alias("target_id"), F.expr("cast(p_partkey % 18 as int)").alias("start"), F.expr("cast(p_partkey % 18 + 8 as int)").alias("end"), F.lit(32).alias("target_len"))
    return alignment, features, hits


D_ALN = f"""al AS (SELECT p_partkey AS aln_id, 'geneA' || p_partkey AS seq_id, {ROW.format(c='a', k='p_partkey')} AS aln FROM part UNION ALL SELECT p_partkey, 'geneB' || p_partkey, {ROW.format(c='b', k='p_partkey')} FROM part UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '_R_' ELSE '' END || 't' || p_partkey, {ROW.format(c='c', k='p_partkey')} FROM part),
 co AS (SELECT aln_id, seq_id, aln, unnest(range(1, 49)) AS i FROM al), cb AS MATERIALIZED (SELECT aln_id, seq_id, i - 1 AS col, row_number() OVER (PARTITION BY aln_id, seq_id ORDER BY i) - 1 AS pos FROM co WHERE substring(aln, i, 1) <> '-'),
 fe AS (SELECT p_partkey AS aln_id, 'geneA' || p_partkey AS gene, 3 AS s, 15 AS e FROM part UNION ALL SELECT p_partkey, 'geneA' || p_partkey, 20, 30 FROM part UNION ALL SELECT p_partkey, 'geneB' || p_partkey, 5, 28 FROM part),
 fc AS (SELECT fe.aln_id AS aln_id, gene, a.col AS s, b.col + 1 AS e FROM fe JOIN cb a ON a.aln_id = fe.aln_id AND a.seq_id = gene AND a.pos = s JOIN cb b ON b.aln_id = fe.aln_id AND b.seq_id = gene AND b.pos = e - 1),
 fp AS (SELECT DISTINCT aln_id, gene, unnest(range(s, e)) AS col FROM fc), fo AS (SELECT fp.aln_id AS aln_id, gene, fp.col AS col FROM fp JOIN cb ON cb.aln_id = fp.aln_id AND cb.seq_id = gene AND cb.col = fp.col),
 gp AS (SELECT aln_id, gene, col, col - row_number() OVER (PARTITION BY aln_id, gene ORDER BY col) AS k FROM (SELECT * FROM fp EXCEPT SELECT * FROM fo)), gg AS (SELECT aln_id, gene, min(col) AS s, max(col) + 1 AS e FROM gp GROUP BY aln_id, gene, k),
 ow AS (SELECT al.aln_id AS aln_id, seq_id, aln, gene FROM al JOIN (SELECT DISTINCT aln_id, gene FROM fe) USING (aln_id) WHERE seq_id NOT LIKE 'gene%' OR seq_id = gene),
 ep AS (SELECT ow.aln_id AS aln_id, seq_id, ow.gene AS gene, col FROM ow JOIN fo ON fo.aln_id = ow.aln_id AND fo.gene = ow.gene UNION SELECT ow.aln_id, seq_id, ow.gene, unnest(range(s, e)) FROM ow JOIN gg ON gg.aln_id = ow.aln_id AND gg.gene = ow.gene WHERE length(replace(substring(aln, s + 1, e - s), '-', '')) <= 1),
 ei AS (SELECT *, col - row_number() OVER (PARTITION BY aln_id, seq_id, gene ORDER BY col) AS k FROM ep), er AS (SELECT aln_id, seq_id, gene, min(col) AS "start", max(col) + 1 AS "end" FROM ei GROUP BY aln_id, seq_id, gene, k)"""


@query(f"WITH {D_ALN} SELECT * FROM er")
def effective_feature_ranges(spark, d):
    alignment, features, _ = _aligned(spark, d)
    return aln.effective_ranges(alignment, features, 1).select("aln_id", "seq_id", "gene", *big("start", "end"))


D_PLACED = f"""{D_ALN}, hi AS (SELECT p_partkey AS hit_id, CASE WHEN p_partkey % 3 = 0 THEN '_R_' ELSE '' END || 't' || p_partkey AS seq_id, p_partkey % 3 = 0 AS turned, CASE WHEN p_partkey % 3 = 0 THEN 32 - (p_partkey % 18 + 8) ELSE p_partkey % 18 END AS s FROM part),
 pl AS (SELECT hit_id, hi.seq_id AS seq_id, CASE WHEN turned THEN '-' ELSE '+' END AS sense, a.col AS "start", b.col + 1 AS "end" FROM hi LEFT JOIN cb a ON a.aln_id = hit_id AND a.seq_id = hi.seq_id AND a.pos = s LEFT JOIN cb b ON b.aln_id = hit_id AND b.seq_id = hi.seq_id AND b.pos = s + 7)"""


@query(f"""WITH {D_PLACED} SELECT hit_id, seq_id, sense, "start", "end" FROM pl""")
def aln_target_join(spark, d):
    alignment, _, hits = _aligned(spark, d)
    return aln.aligned_hits(hits, alignment).select("hit_id", "seq_id", "sense", *big("start", "end"))


@query(f"""WITH {D_PLACED}, w AS (SELECT hit_id, sense, gene, coalesce(bool_or(pl."start" >= er."start" AND pl."end" <= er."end"), false) AS ok FROM pl JOIN er ON er.aln_id = hit_id AND er.seq_id = pl.seq_id GROUP BY ALL)
 SELECT hit_id, sense, count(*) FILTER (WHERE ok) AS n_within, count(*) FILTER (WHERE ok) >= 1 AND count(*) FILTER (WHERE ok) / count(*) >= 0.6 AS feature FROM w GROUP BY hit_id, sense""")
def feature_check(spark, d):
    alignment, features, hits = _aligned(spark, d)
    return aln.feature_check(hits, alignment, features, 1, 1, 0.6)


@query()
def align_reference(spark, d):
    """Two versions of each gene aligned, with a row for the coding sequence of each."""
    genes, coding, _ = sub.gene_sets(spark, d)
    return msa.aligned_references(genes, coding)


@query()
def align_targets(spark, d):
    """Three targets a gene added to its alignment, turned round where that fits better."""
    genes, coding, targets = sub.gene_sets(spark, d)
    return msa.added_targets(msa.aligned_references(genes, coding), targets)


@query()
def feature_check_aligned(spark, d):
    """From raw sequences to the feature check: targets are aligned with their genes, and the
    guides found on them are held against the genes' coding ranges."""
    genes, coding, targets = sub.gene_sets(spark, d)
    whole = stored(msa.added_targets(msa.aligned_references(genes, coding), targets), "aligned")
    named = targets.withColumnRenamed("seq_id", "target_id")
    hits = sq.guides(named, Pam.parse("NGG")).join(named.select("target_id", F.length("seq").alias("target_len")), "target_id")
    hits = hits.select(F.concat_ws("|", "target_id", "strand", "start").alias("hit_id"), "target_id", "start", "end", "target_len")
    return aln.feature_check(hits, whole, coding.select("aln_id", "seq_id", "start", "end"), 8, 1, 0.5)


@query(f"""WITH a0 AS (SELECT p_partkey, {ROW.format(c='a', k='p_partkey')} AS g, {ROW.format(c='b', k='p_partkey')} AS c FROM part), ch AS (SELECT p_partkey, g, c, unnest(range(1, 49)) AS i FROM a0),
 cc AS (SELECT p_partkey, g, c, i - 1 AS col, i - row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS k FROM ch WHERE substring(c, i, 1) <> '-'), rn AS (SELECT p_partkey, g, c, min(col) AS s, max(col) + 1 AS e FROM cc GROUP BY p_partkey, g, c, k),
 bl AS (SELECT p_partkey, length(replace(substring(g, 1, s), '-', '')) AS "start", length(replace(substring(g, 1, e), '-', '')) AS "end", length(replace(substring(c, 1, s), '-', '')) % 3 AS phase, row_number() OVER (PARTITION BY p_partkey ORDER BY s) AS n FROM rn)
 SELECT 'G' || p_partkey AS seqid, 'gene' AS type, 'G' || p_partkey AS id, NULL AS parent, 0 AS "start", length(replace(g, '-', '')) AS "end", NULL AS phase FROM a0 UNION ALL SELECT 'G' || p_partkey, 'mRNA', 'G' || p_partkey || '.1', 'G' || p_partkey, min("start"), max("end"), NULL FROM bl GROUP BY p_partkey
 UNION ALL SELECT 'G' || p_partkey, 'CDS', 'G' || p_partkey || '.1.cds' || lpad(CAST(n AS VARCHAR), 6, '0'), 'G' || p_partkey || '.1', "start", "end", phase FROM bl""")
def infer_annotation(spark, d):
    p = sub.table(spark, d, "part")
    row = lambda c: F.expr(ROW.format(c=c, k="p_partkey"))
    rows = F.array(F.struct(F.expr("concat('G', p_partkey)").alias("seq_id"), row("a").alias("aln"), F.lit("gene").alias("kind")), F.struct(F.expr("concat('G', p_partkey, '.1')").alias("seq_id"), row("b").alias("aln"), F.lit("cds").alias("kind")))
    found = aln.inferred_annotation(p.select(F.col("p_partkey").alias("aln_id"), F.explode(rows).alias("x")).select("aln_id", "x.*"))
    return found.select("seqid", "type", "id", "parent", *big("start", "end", "phase"))


# covers ---------------------------------------------------------------------------------------


@query(f"""WITH {sub.D_HITS}, c AS (SELECT grna, list_sort(list_distinct(list(target_id))) AS ts, avg(CASE WHEN sense = '-' THEN target_len - "end" ELSE "start" END) AS pos FROM h GROUP BY grna) SELECT array_to_string(ts, ',') AS targets, arg_min(grna, struct_pack(a := pos, b := grna)) AS most_5prime, arg_min(grna, struct_pack(a := -pos, b := grna)) AS least_5prime FROM c GROUP BY ts""")
def most_5prime(spark, d):
    hits = sub.hits(spark, d)
    groups = cov.collapsed(hits)
    ends = cov.ends_of_groups(groups, cov.relative_position(hits))
    return groups.select("cg", F.array_join("targets", ",").alias("targets")).distinct().join(ends, "cg").select("targets", "most_5prime", "least_5prime")


D_SOLUTIONS = "so AS (SELECT DISTINCT o_custkey AS solution, l_partkey % 40 AS member FROM orders JOIN lineitem ON l_orderkey = o_orderkey), me AS (SELECT l_partkey % 40 AS member, list_distinct(list(l_suppkey % 30)) AS targets FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), sm AS (SELECT solution, so.member AS member, targets FROM so JOIN me USING (member))"


def _solutions(spark, d):
    t = sub.table(spark, d, "lineitem")
    so = sub.table(spark, d, "orders").join(t, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("solution"), F.expr("l_partkey % 40").alias("member")).distinct()
    me = t.where("l_linenumber = 1").groupBy(F.expr("l_partkey % 40").alias("member")).agg(F.collect_set(F.expr("l_suppkey % 30")).alias("targets"))
    return so.join(me, "member")


D_RANKED = f"{D_SOLUTIONS}, sr AS (SELECT solution, count(*) AS size, sum(len(targets))::BIGINT - len(list_distinct(flatten(list(targets)))) AS redundancy, max(len(targets)) AS max_coverage, min(len(targets)) AS min_coverage FROM sm GROUP BY solution)"


@query(f"WITH {D_RANKED} SELECT solution, size, redundancy, max_coverage, row_number() OVER (ORDER BY size, redundancy, max_coverage DESC, solution) AS rank FROM sr")
def solution_rank(spark, d):
    return rec.ranked_solutions(_solutions(spark, d)).select("solution", *big("size", "redundancy", "max_coverage", "rank"))


@query(f"WITH {D_RANKED} SELECT solution, max_coverage, min_coverage FROM sr")
def coverage_minmax(spark, d):
    return rec.ranked_solutions(_solutions(spark, d)).select("solution", *big("max_coverage", "min_coverage"))


@query(f"WITH {D_SOLUTIONS}, u AS (SELECT [x FOR x IN range(0, 30) IF x % 2 = 0] AS un), r AS (SELECT solution, member, len(targets) AS w, len(list_intersect(un, targets)) AS c, len(un) AS n FROM sm, u) SELECT solution, member, CASE c WHEN 0 THEN -1.0 ELSE round(w / c + (n - c) * (w / c) * 0.5, 6) END AS ratio FROM r")
def wc_ratio(spark, d):
    rows = _solutions(spark, d).withColumn("un", F.expr("filter(sequence(0L, 29L), x -> x % 2 = 0)"))
    ratio = cvs.wc_ratio(F.size("targets"), F.col("targets"), F.col("un"), 0.5)
    return rows.select("solution", "member", F.when(ratio == float("inf"), -1.0).otherwise(F.round(ratio, 6)).alias("ratio"))


#: A panel of at most 211 groups over 25 targets.
D_PANEL = "pn AS (SELECT 'g' || lpad(CAST(c_custkey % 211 AS VARCHAR), 3, '0') AS cg, list_sort(list_distinct(list(c_nationkey))) AS ts FROM customer GROUP BY c_custkey % 211)"


def _panel(spark, d):
    return sub.table(spark, d, "customer").groupBy(F.expr("concat('g', lpad(cast(c_custkey % 211 as string), 3, '0'))").alias("cg")).agg(F.array_sort(F.collect_set("c_nationkey")).alias("targets"))


@query(f"""WITH RECURSIVE {D_PANEL}, un AS (SELECT list_distinct(flatten(list(ts))) AS u FROM pn), st AS (SELECT 0 AS n, (SELECT u FROM un) AS open, CAST(NULL AS VARCHAR) AS pick UNION ALL
 SELECT n + 1, list_filter(open, lambda x: NOT list_contains(ts, x)), cg FROM (SELECT n, open, ts, cg, row_number() OVER (ORDER BY len(ts) / len(list_intersect(open, ts)) + (len(open) - len(list_intersect(open, ts))) * (len(ts) / len(list_intersect(open, ts))) * 0.25, len(ts) DESC, cg) AS k FROM st, pn WHERE len(open) > 0 AND len(list_intersect(open, ts)) > 0) WHERE k = 1) SELECT n AS step, pick AS cg FROM st WHERE n > 0""")
def approx_min_sc(spark, d):
    return cvs.approximate_cover(_panel(spark, d), penalty=0.25).select(*big("step"), "cg")


@query()
def enum_covers(spark, d):
    return cvs.enumerated_covers(_panel(spark, d), 50)


@query()
def limited_minweight(spark, d):
    return cvs.limited_minweight(_panel(spark, d), 1)


D_OPTIMAL = f"""{D_PANEL}, bi AS (SELECT cg, ts, list_sum(list_transform(ts, lambda x: 1::BIGINT << x::BIGINT))::BIGINT AS b FROM pn), al AS (SELECT bit_or(b) AS u FROM bi),
 s1 AS (SELECT [cg] AS m FROM bi, al WHERE b = u), s2 AS (SELECT [x.cg, y.cg] AS m FROM bi x JOIN bi y ON x.cg < y.cg, al WHERE x.b | y.b = u AND x.b <> u AND y.b <> u AND len(x.ts) + len(y.ts) - bit_count(u) <= 0.4 * bit_count(u)),
 s3 AS (SELECT [x.cg, y.cg, z.cg] AS m FROM bi x JOIN bi y ON x.cg < y.cg JOIN bi z ON y.cg < z.cg, al WHERE x.b | y.b | z.b = u AND x.b | y.b <> u AND x.b | z.b <> u AND y.b | z.b <> u AND len(x.ts) + len(y.ts) + len(z.ts) - bit_count(u) <= 0.4 * bit_count(u))"""


@query(f"WITH {D_OPTIMAL} SELECT array_to_string(m, ',') AS members FROM (SELECT m FROM s1 UNION ALL SELECT m FROM s2 UNION ALL SELECT m FROM s3)")
def limited_optimal(spark, d):
    found = cvs.limited_optimal(_panel(spark, d), 3, 0.4)
    return found.groupBy("solution").agg(F.array_join(F.array_sort(F.collect_list("cg")), ",").alias("members")).select("members")


@query()
def set_cover_nr(spark, d):
    c = sub.table(spark, d, "customer")
    hits = c.select(F.expr("concat('g', c_custkey % 211)").alias("grna"), F.col("c_nationkey").cast("string").alias("target_id"), F.expr("cast(c_custkey % 900 as int)").alias("start"), F.expr("cast(c_custkey % 900 + 20 as int)").alias("end"), F.lit("+").alias("sense"), F.lit(1000).alias("target_len"))
    return cvs.nonredundant_sets(hits, 2)


GREEDY = """{src}, pt AS (SELECT grna, target_id, sum(CASE WHEN sense = '-' THEN target_len - "end" ELSE "start" END) AS s, count(*) AS n FROM {rows} GROUP BY grna, target_id), cv AS (SELECT grna, list(struct_pack(t := target_id, s := s, n := n)) AS ts FROM pt GROUP BY grna), un AS (SELECT count(DISTINCT target_id) AS u FROM {universe}),
 st AS (SELECT 0 AS n, 1 AS set_number, CAST([] AS VARCHAR[]) AS covered, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS pick UNION ALL
 SELECT n + 1, sn, list_concat(cov0, list_transform(new, lambda x: x.t)), list_append(used, grna), grna FROM (SELECT *, row_number() OVER (ORDER BY len(new) DESC, {pos}, len(ts) - len(new), grna) AS k FROM (SELECT *, list_filter(ts, lambda x: NOT list_contains(cov0, x.t)) AS new FROM
 (SELECT n, used, CASE WHEN len(covered) = u THEN set_number + 1 ELSE set_number END AS sn, CASE WHEN len(covered) = u THEN CAST([] AS VARCHAR[]) ELSE covered END AS cov0, grna, ts FROM st, cv, un WHERE u > 0 AND NOT (len(covered) = u AND set_number = {sets}) AND NOT list_contains(used, grna))) WHERE len(new) > 0) WHERE k = 1),
 dn AS (SELECT set_number FROM st, un GROUP BY set_number, u HAVING max(len(covered)) = u)"""
POS_NEW = "list_sum(list_transform(new, lambda x: x.s)) / list_sum(list_transform(new, lambda x: x.n))"
POS_ALL = "list_sum(list_transform(ts, lambda x: x.s)) / list_sum(list_transform(ts, lambda x: x.n))"


def _sql_sets(source: str, rows: str, universe: str, pos: str, sets: int) -> str:
    return f"WITH RECURSIVE {GREEDY.format(src=source, rows=rows, universe=universe, pos=pos, sets=sets)} SELECT set_number, pick AS grna FROM st WHERE pick IS NOT NULL AND set_number IN (SELECT set_number FROM dn)"


@query(_sql_sets(sub.D_HITS, "h", "h", POS_NEW, 1))
def set_cover_lar(spark, d):
    return cov.exclusive_sets(sub.hits(spark, d), 1)


@query(_sql_sets(sub.D_HITS, "h", "h", POS_ALL, 1))
def set_cover_greedy(spark, d):
    return cov.exclusive_sets(sub.hits(spark, d), 1, algorithm="greedy")


@query(_sql_sets(sub.D_HITS, "h", "h", POS_NEW, 3))
def mutually_exclusive_sets(spark, d):
    return cov.exclusive_sets(sub.hits(spark, d), 3)


@query(_sql_sets(f"{D_GUIDE_CHECKS}, {VALID}", "v", "h", POS_NEW, 2))
def minimum_set(spark, d):
    """Sets of guides that pass all checks, over the targets of all guides, passing or not."""
    guides, hits = _checked(spark, d)
    _, valid = chk.valid_guides(guides, hits)
    return cov.exclusive_sets(valid, 2, targets=hits)


@query(f"""WITH {sub.D_HITS}, pt AS (SELECT grna, target_id, sum(CASE WHEN sense = '-' THEN target_len - "end" ELSE "start" END) AS s, count(*) AS n, CAST(target_id AS BIGINT) % 3 = 0 AS old FROM h GROUP BY grna, target_id) SELECT grna, count(*) FILTER (WHERE NOT old) AS gain, round(sum(s) FILTER (WHERE NOT old) / sum(n) FILTER (WHERE NOT old), 6) AS pos, count(*) FILTER (WHERE old) AS redundancy FROM pt GROUP BY grna""")
def tie_break(spark, d):
    covered = sub.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.expr("cast(s_suppkey as string)").alias("target"))
    return cov.tie_keys(cov.paired(sub.hits(spark, d)), covered).select("grna", *big("gain"), F.round("pos", 6).alias("pos"), *big("redundancy"))
