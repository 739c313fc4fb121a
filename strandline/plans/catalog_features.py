"""Queries of targets, features, attributes and sequences, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.parameters import parsed_renames
from strandline.operators import features as ft
from strandline.operators import ranges as rg
from strandline.operators import sequences as sq
from strandline.operators import targets as tg
from strandline.operators.joins import dealt
from strandline.plans import substrate as sub
from strandline.plans.registry import big, query

# ids, senses, ranges -----------------------------------------------------------------------

SEQID = "concat('Reference|src', s_nationkey, '|gene', s_suppkey, '|CDS|', s_suppkey % 7, '-', s_suppkey % 7 + 40)"


@query(f"WITH x AS (SELECT s_suppkey, {SEQID} AS i FROM supplier) SELECT s_suppkey, split_part(i, '|', 2) AS source, split_part(i, '|', 3) AS gene, split_part(i, '|', 4) AS feature, split_part(i, '|', -1) AS place FROM x")
def seqid_parts(spark, d):
    i = F.expr(SEQID)
    return sub.table(spark, d, "supplier").select("s_suppkey", tg.id_part(i, 1).alias("source"), tg.id_part(i, 2).alias("gene"), tg.id_part(i, 3).alias("feature"), tg.id_part(i, -1).alias("place"))


@query("SELECT s_suppkey, 'Reference|' || s_name || '|' || s_suppkey || '|' || coalesce(CASE WHEN s_nationkey > 9 THEN CAST(s_nationkey AS VARCHAR) END, '.') || '|1-' || s_suppkey + 3 AS seqid FROM supplier")
def seqid_render(spark, d):
    values = {"source": F.col("s_name"), "gene": F.col("s_suppkey"), "domain": F.expr("case when s_nationkey > 9 then s_nationkey end"), "end": F.expr("s_suppkey + 3")}
    return sub.table(spark, d, "supplier").select("s_suppkey", tg.rendered_id("Reference|$source|$gene|$domain|1-$end", values).alias("seqid"))


SENSES = "CASE l_returnflag WHEN 'A' THEN 'sense' WHEN 'R' THEN 'antisense' ELSE 'NA' END"
STRANDS = "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'O' THEN '-' ELSE '+' END"


def _senses(spark, d):
    return sub.table(spark, d, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("hit_id"), F.expr(SENSES).alias("parent"), F.expr(STRANDS).alias("strand"), F.expr("cast(l_partkey % 80 as int)").alias("start"), F.expr("cast(l_partkey % 80 + 20 as int)").alias("end"), F.lit(128).alias("len"))


D_SENSES = f"""x AS (SELECT l_orderkey * 10 + l_linenumber AS hit_id, {SENSES} AS parent, {STRANDS} AS strand, l_partkey % 80 AS "start", l_partkey % 80 + 20 AS "end", 128 AS len FROM lineitem),
 y AS (SELECT *, CASE WHEN strand IS NULL OR parent = 'NA' THEN NULL WHEN (parent = 'sense') = (strand = '+') THEN '+' ELSE '-' END AS sense FROM x)"""


@query(f"WITH {D_SENSES} SELECT hit_id, sense, CASE WHEN sense IS NULL THEN 'NA' ELSE parent END AS parent FROM y")
def target_sense(spark, d):
    rows = _senses(spark, d).withColumn("sense", tg.sense_from_parent(F.col("parent"), F.col("strand")))
    return rows.select("hit_id", "sense", tg.parent_sense(F.col("sense"), F.col("strand"), words=True).alias("parent"))


@query(f"""WITH {D_SENSES}, z AS (SELECT *, CASE parent WHEN 'sense' THEN '+' WHEN 'antisense' THEN '-' END AS p FROM y) SELECT hit_id, CASE strand WHEN '+' THEN "start" WHEN '-' THEN len - "end" END AS s_strand, CASE strand WHEN '+' THEN "end" WHEN '-' THEN len - "start" END AS e_strand,
 CASE WHEN strand IS NULL OR p IS NULL THEN NULL WHEN strand = p THEN "start" ELSE len - "end" END AS s_sense, CASE WHEN strand IS NULL OR p IS NULL THEN NULL WHEN strand = p THEN "end" ELSE len - "start" END AS e_sense FROM z""")
def adj_range(spark, d):
    rows = _senses(spark, d).withColumn("p", tg.plus_or_minus(F.col("parent")))
    c = [F.col(n) for n in ("start", "end", "len", "strand")]
    (s, e), (s2, e2) = tg.adjusted_range(*c), tg.adjusted_range(*c, F.col("p"))
    return rows.select("hit_id", *[x.cast("long").alias(n) for x, n in ((s, "s_strand"), (e, "e_strand"), (s2, "s_sense"), (e2, "e_sense"))])


@query(f"""WITH {sub.D_TARGETS}, {sub.D_GUIDES}, f AS (SELECT target_id, strand, "start", substring(s, greatest(CASE strand WHEN '+' THEN "start" ELSE length(s) - "start" - 20 END - 30, 0) + 1, least(CASE strand WHEN '+' THEN "start" ELSE length(s) - "start" - 20 END, 30)) AS before,
 substring(s, CASE strand WHEN '+' THEN "start" ELSE length(s) - "start" - 20 END + 21, 30) AS after FROM g JOIN b USING (target_id, strand)) SELECT * FROM f""")
def flank(spark, d):
    t = sub.targets(spark, d)
    hits = sq.guides(t, sq.Pam.parse("NGG")).join(t, "target_id")
    before, after = tg.flanks(F.col("seq"), F.col("start"), F.col("end"), F.col("strand"), 30)
    return hits.select("target_id", "strand", *big("start"), before.alias("before"), after.alias("after"))


@query(f"""WITH {sub.D_HITS}, p AS (SELECT grna, target_id, sum(CASE WHEN sense = '-' THEN target_len - "end" ELSE "start" END) AS s, count(*) AS n FROM h GROUP BY ALL),
 q AS (SELECT CAST(p_partkey AS VARCHAR) AS a, CAST(p_partkey + 1 AS VARCHAR) AS b FROM part) SELECT q.a AS a, q.b AS b, count(*) AS common, round(sum(x.s) / sum(x.n) - sum(y.s) / sum(y.n), 6) AS distance FROM q JOIN p x ON x.grna = q.a JOIN p y ON y.grna = q.b AND x.target_id = y.target_id GROUP BY q.a, q.b""")
def relative_5prime(spark, d):
    pairs = sub.table(spark, d, "part").select(F.expr("cast(p_partkey as string)").alias("a"), F.expr("cast(p_partkey + 1 as string)").alias("b"))
    return tg.distance_to_5prime(pairs, sub.hits(spark, d)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {sub.D_HITS}, t AS (SELECT CAST(s_suppkey AS VARCHAR) AS target_id, s_suppkey % 90 + 500 AS n FROM supplier WHERE s_suppkey % 3 > 0) SELECT hit_id, coalesce(t.n, target_len) AS target_len FROM h LEFT JOIN t USING (target_id)")
def map_target_len(spark, d):
    t = sub.table(spark, d, "supplier").where("s_suppkey % 3 > 0").select(F.expr("cast(s_suppkey as string)").alias("target_id"), F.expr("repeat('N', cast(s_suppkey % 90 + 500 as int))").alias("seq"))
    return tg.with_target_lengths(sub.hits(spark, d), t).select("hit_id", *big("target_len"))


@query(f"WITH {sub.D_CODING}, r AS (SELECT o_orderkey AS gene, [o_orderkey % 300, o_orderkey % 300 + 400] AS s FROM orders) SELECT cd.gene AS gene, count(*) FILTER (WHERE (\"start\" >= s[1] AND \"end\" <= s[1] + 150) OR (\"start\" >= s[2] AND \"end\" <= s[2] + 200)) AS n FROM cd JOIN r USING (gene) GROUP BY cd.gene")
def range_within_any(spark, d):
    ranges = sub.table(spark, d, "orders").select(F.col("o_orderkey").alias("gene"), F.expr("array(named_struct('start', o_orderkey % 300, 'end', o_orderkey % 300 + 150), named_struct('start', o_orderkey % 300 + 400, 'end', o_orderkey % 300 + 600))").alias("ranges"))
    return sub.coding(spark, d).join(ranges, "gene").groupBy("gene").agg(F.count_if(rg.within_any(F.col("start"), F.col("end"), F.col("ranges"))).alias("n"))


# features ---------------------------------------------------------------------------------

RENAMES = "mRNA:Parent=Locus_id;all:ID=Name"
D_FEATURES = """f AS (SELECT l_orderkey * 10 + l_linenumber AS line_no, 'chr' || l_suppkey % 9 AS seqid, CASE l_linenumber % 3 WHEN 0 THEN 'gene' WHEN 1 THEN 'mRNA' ELSE 'CDS' END AS type, l_partkey % 97 AS "start", l_partkey % 97 + l_suppkey % 40 + 1 AS "end", 'f' || l_orderkey || '.' || l_linenumber AS name,
 'g' || l_orderkey AS p1, 'h' || l_suppkey % 5 AS p2 FROM lineitem)"""


def _features(spark, d):
    """Features with attributes whose names differ by type, as a map."""
    attrs = "concat('Name=f', l_orderkey, '.', l_linenumber, ';', case l_linenumber % 3 when 1 then 'Locus_id' else 'Parent' end, '=g', l_orderkey, ',h', l_suppkey % 5)"
    rows = sub.table(spark, d, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("line_no"), F.expr("concat('chr', l_suppkey % 9)").alias("seqid"), F.expr("element_at(array('gene', 'mRNA', 'CDS'), cast(l_linenumber % 3 + 1 as int))").alias("type"),
        F.expr("l_partkey % 97").alias("start"), F.expr("l_partkey % 97 + l_suppkey % 40 + 1").alias("end"), F.expr(attrs).alias("attrs"))
    return rows


def _mapped(spark, d):
    return ft.with_attribute_map(_features(spark, d))


@query(f"WITH {D_FEATURES} SELECT line_no, name AS id, p1 || ',' || p2 AS parents, p2 = 'h3' AS of_h3 FROM f")
def attr_lookup(spark, d):
    renamed, a, t = parsed_renames(RENAMES), F.col("attributes"), F.col("type")
    return _mapped(spark, d).select("line_no", F.array_join(ft.attribute(a, t, "ID", renamed), ",").alias("id"), F.array_join(ft.attribute(a, t, "Parent", renamed), ",").alias("parents"), ft.has_attribute(a, t, "Parent", ["h3", "x"], renamed).alias("of_h3"))


@query(f"WITH {D_FEATURES} SELECT line_no, 'ID=' || name || ';Parent=' || p1 || ',' || p2 AS attrs FROM f")
def attr_standardise(spark, d):
    m = ft.standardised(F.col("attributes"), F.col("type"), parsed_renames(RENAMES))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return _mapped(spark, d).select("line_no", text.alias("attrs"))


@query("""WITH x AS (SELECT 'mRNA:Parent=L' || n_nationkey || ',ID=I' || n_nationkey || ';all:Note=N' || n_regionkey AS s, n_nationkey FROM nation), y AS (SELECT n_nationkey, unnest(string_split(s, ';')) AS p FROM x),
 z AS (SELECT n_nationkey, split_part(p, ':', 1) AS feature, unnest(string_split(split_part(p, ':', 2), ',')) AS m FROM y) SELECT n_nationkey, feature, split_part(m, '=', 1) AS name, split_part(m, '=', 2) AS spelling FROM z""")
def attr_mod_parse(spark, d):
    from strandline.functions.parameters import renames

    rows = sub.table(spark, d, "nation").select("n_nationkey", F.expr("concat('mRNA:Parent=L', n_nationkey, ',ID=I', n_nationkey, ';all:Note=N', n_regionkey)").alias("s"))
    return rows.select("n_nationkey", F.explode(renames(F.col("s"))).alias("x")).select("n_nationkey", "x.*")


@query(f"""WITH {D_FEATURES} SELECT seqid, type, "start", "end", min(line_no) AS line_no FROM f GROUP BY ALL""")
def feature_dedupe(spark, d):
    return ft.distinct_features(_features(spark, d).select("line_no", "seqid", "type", "start", "end"))


@query(f"WITH {D_FEATURES} SELECT line_no, type FROM f WHERE type IN ('gene', 'CDS')")
def features_by_type(spark, d):
    return ft.of_types(_features(spark, d), ["gene", "CDS"]).select("line_no", "type")


@query(f"WITH {D_FEATURES} SELECT line_no, name AS id FROM f JOIN (SELECT DISTINCT 'f' || o_orderkey || '.1' AS k FROM orders WHERE o_orderpriority LIKE '1%') ON name = k")
def features_by_id(spark, d):
    rows = _mapped(spark, d).select("line_no", F.element_at("attributes", "Name")[0].alias("id"))
    return ft.with_ids(rows, sub.table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.expr("concat('f', o_orderkey, '.1')").alias("id"))).select("line_no", "id")


@query(f"WITH {D_FEATURES} SELECT line_no, seqid FROM f WHERE line_no IN (SELECT o_orderkey * 10 + 2 FROM orders)")
def features_by_row(spark, d):
    return ft.at_lines(_features(spark, d), sub.table(spark, d, "orders").select(F.expr("o_orderkey * 10 + 2").alias("line_no"))).select("line_no", "seqid")


@query(f"""WITH {D_FEATURES}, o AS (SELECT seqid, min(line_no) AS k FROM f GROUP BY seqid) SELECT line_no, row_number() OVER (ORDER BY k, "start", "end" DESC, type, line_no) AS place FROM f JOIN o USING (seqid)""")
def gff_sort(spark, d):
    rows = _features(spark, d).withColumn("ann_source", F.lit("src"))
    from strandline.operators.prefix import global_prefix

    first = rows.groupBy("seqid").agg(F.min("line_no").alias("first"))
    placed = global_prefix(rows.join(first, "seqid").select("line_no", "first", "start", "end", "type"), ["first", "start", F.desc("end"), "type", "line_no"], [])
    return placed.select("line_no", (F.col("row_before") + 1).alias("place"))


@query("""WITH c AS (SELECT CASE WHEN l_linenumber = 6 THEN 'lone' || l_orderkey ELSE 'g' || l_orderkey || '.' || l_linenumber END AS cds_id FROM lineitem), g AS (SELECT 'g' || o_orderkey * 2 AS gene_id FROM orders), n AS (SELECT cds_id, CASE WHEN contains(cds_id, '.') THEN split_part(cds_id, '.', 1) END AS named FROM c)
 SELECT coalesce(gene_id, named) AS gene_id, cds_id, CASE WHEN gene_id IS NULL THEN 'cds' WHEN cds_id IS NULL THEN 'gene' END AS orphan FROM n FULL JOIN g ON named = gene_id""")
def group_by_gene(spark, d):
    coding = sub.table(spark, d, "lineitem").select(F.expr("case when l_linenumber = 6 then concat('lone', l_orderkey) else concat('g', l_orderkey, '.', l_linenumber) end").alias("cds_id"))
    return ft.gene_groups(coding, sub.table(spark, d, "orders").select(F.expr("concat('g', o_orderkey * 2)").alias("gene_id")))


@query("SELECT 'c' || c_custkey AS seq_id, 'n' || n_nationkey AS gene_seq_id, c_mktsegment AS source FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = CASE n_regionkey WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END")
def cds_gene_join(spark, d):
    coding = sub.table(spark, d, "customer").select(F.expr("concat('c', c_custkey)").alias("seq_id"), F.col("c_mktsegment").alias("source"), F.col("c_nationkey").alias("gene"))
    genes = sub.table(spark, d, "nation").select(F.expr("concat('n', n_nationkey)").alias("seq_id"), F.expr("case n_regionkey when 0 then 'BUILDING' else 'MACHINERY' end").alias("source"), F.col("n_nationkey").alias("gene"))
    return ft.genes_of_coding(coding, genes).select("seq_id", "gene_seq_id", "source")


@query("""WITH x AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS p, 'mRNA' AS type FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'CDS' FROM customer UNION ALL SELECT 'r' || r_regionkey, NULL, 'gene' FROM region)
 SELECT id, type FROM x WHERE id IN ('r1', 'r3') OR p IN ('r1', 'r3') OR p IN (SELECT id FROM x WHERE p IN ('r1', 'r3'))""")
def subset_annotation(spark, d):
    n = sub.table(spark, d, "nation").select(F.expr("concat('n', n_nationkey)").alias("id"), F.expr("array(concat('r', n_regionkey))").alias("parents"), F.lit("mRNA").alias("type"))
    c = sub.table(spark, d, "customer").select(F.expr("concat('c', c_custkey)").alias("id"), F.expr("array(concat('n', c_nationkey))").alias("parents"), F.lit("CDS").alias("type"))
    r = sub.table(spark, d, "region").select(F.expr("concat('r', r_regionkey)").alias("id"), F.expr("cast(array() as array<string>)").alias("parents"), F.lit("gene").alias("type"))
    genes = sub.table(spark, d, "region").where("r_regionkey in (1, 3)").select(F.expr("concat('r', r_regionkey)").alias("id"))
    return ft.subset_annotation(n.unionByName(c).unionByName(r), genes).select("id", "type")


# sequences of features --------------------------------------------------------------------

D_PARTS = """tp AS (SELECT t.target_id AS target_id, seq, l_orderkey AS gene, CASE WHEN l_orderkey % 2 = 0 THEN '-' ELSE '+' END AS strand, l_linenumber * 14 + l_suppkey % 5 AS "start", l_linenumber * 14 + l_suppkey % 5 + l_suppkey % 20 + 1 AS "end" FROM lineitem JOIN t ON t.target_id = CAST(1 + l_orderkey % (SELECT count(*) FROM part) AS VARCHAR)),
 pp AS (SELECT DISTINCT gene, target_id, strand, unnest(range("start", "end")) AS pos FROM tp), pi AS (SELECT *, pos - row_number() OVER (PARTITION BY gene ORDER BY pos) AS k FROM pp),
 pr AS (SELECT gene, target_id, strand, min(pos) AS "start", max(pos) + 1 AS "end" FROM pi GROUP BY gene, target_id, strand, k)"""


def _parts(spark, d):
    """Overlapping coding parts of genes on both strands; each gene on one target of all."""
    t, n = sub.targets(spark, d), sub.table(spark, d, "part").count()
    rows = sub.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gene"), F.expr(f"cast(1 + l_orderkey % {n} as string)").alias("target_id"), F.expr("case when l_orderkey % 2 = 0 then '-' else '+' end").alias("strand"),
        F.expr("cast(l_linenumber * 14 + l_suppkey % 5 as int)").alias("start"), F.expr("cast(l_linenumber * 14 + l_suppkey % 5 + l_suppkey % 20 + 1 as int)").alias("end"))
    return rows, t


@query(f"""WITH {sub.D_TARGETS}, {D_PARTS}, j AS (SELECT gene, strand, string_agg(substring(seq, pr."start" + 1, pr."end" - pr."start"), '' ORDER BY pr."start") AS s FROM pr JOIN t USING (target_id) GROUP BY gene, strand) SELECT gene, CASE strand WHEN '-' THEN reverse(translate(s,'ACGT','TGCA')) ELSE s END AS seq FROM j""")
def extract_ranges(spark, d):
    rows, t = _parts(spark, d)
    return sq.feature_sequences(rows, t, ["gene"]).select("gene", "seq")


@query(f"""WITH {sub.D_TARGETS}, {D_PARTS}, j AS (SELECT gene, strand, string_agg(substring(seq, pr."start" + 1, pr."end" - pr."start"), '' ORDER BY pr."start") AS s, string_agg((pr."start" + 1) || '-' || pr."end", ',' ORDER BY pr."start") AS places FROM pr JOIN t USING (target_id) GROUP BY gene, strand),
 k AS (SELECT gene, places, CASE strand WHEN '-' THEN reverse(translate(s,'ACGT','TGCA')) ELSE s END AS seq FROM j) SELECT 'Reference|' || gene || '|' || places AS seq_id, array_to_string(list_transform(range(1, length(seq) - 1, 3), lambda i: substring('{sq.STANDARD_CODE}', CAST((strpos('ACGT', substring(seq, i, 1)) - 1) * 16 + (strpos('ACGT', substring(seq, i + 1, 1)) - 1) * 4 + strpos('ACGT', substring(seq, i + 2, 1)) AS INTEGER), 1)), '') AS seq FROM k""")
def reference_seq(spark, d):
    rows, t = _parts(spark, d)
    found = sq.feature_sequences(rows, t, ["gene"], translate=True)
    return found.select(tg.rendered_id("Reference|$gene|$places", {"gene": F.col("gene"), "places": F.col("places")}).alias("seq_id"), "seq")


@query(f"""WITH {sub.D_TARGETS}, {D_PARTS}, n AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY gene, "start") AS i FROM pr) SELECT 'q1|' || target_id || '|' || i || '|' || (n."start" + 1) || '-' || n."end" AS seq_id, substring(seq, n."start" + 1, n."end" - n."start") AS seq FROM n JOIN t USING (target_id)""")
def merged_seqs(spark, d):
    rows, t = _parts(spark, d)
    n = rows.count()
    regions = dealt(rg.merged(dealt(rows, ["gene"], n), ["gene", "target_id"]).withColumn("molecule", F.col("target_id")), ["molecule"], n)
    return sq.region_sequences(regions, t.select(F.col("target_id").alias("molecule"), "seq"), "q1", ["gene"])
