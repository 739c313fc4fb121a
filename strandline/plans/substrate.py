"""Genomic tables derived from the test tables by functions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.joins import merged_in_joins, spread

DNA = "translate(concat(md5(concat({k},':0')),md5(concat({k},':1')),md5(concat({k},':2')),md5(concat({k},':3'))),'0123456789abcdef','ACGTACGTACGTACGT')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 128-base target for each part."""
    rows = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return merged_in_joins(rows.select(F.expr("cast(p_partkey as string)").alias("target_id"), F.expr(DNA.format(k="p_partkey")).alias("seq")))


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A background molecule for each supplier: its own bases, then those of a part."""
    own, other = DNA.format(k="concat('s',s_suppkey)"), DNA.format(k="s_suppkey")
    rows = spread(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    return merged_in_joins(rows.select(F.expr("cast(s_suppkey as string)").alias("molecule"), F.expr(f"concat({own}, substring({other}, 1, 90))").alias("seq")))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guide hits: part on supplier."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("hit_id"), F.expr("cast(l_partkey as string)").alias("grna"), F.expr("cast(l_suppkey as string)").alias("target_id"),
        F.expr("cast(l_orderkey % 2000 as int)").alias("start"), F.expr("cast(l_orderkey % 2000 + 20 as int)").alias("end"), F.expr("case when l_linestatus = 'O' then '-' else '+' end").alias("sense"),
        F.lit(2100).alias("target_len"), F.expr("case l_returnflag when 'A' then true when 'R' then false end").alias("background"), F.expr("l_linestatus = 'F'").alias("feature"), F.lit(None).cast("boolean").alias("extra"),
        (F.col("l_discount") * 100).alias("rest"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("mol"), F.unix_timestamp("ts").alias("start"), (F.unix_timestamp("ts") + 600).alias("end"), F.col("value").alias("pident"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gene"), F.expr("cast(o_orderkey % 1000 as int)").alias("g_start"), F.expr("cast(o_orderkey % 1000 + 1000 as int)").alias("g_end"), F.expr("case when o_orderkey % 2 = 0 then '+' else '-' end").alias("strand"))


def coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = "cast(100 * l_linenumber + l_partkey % 50 as int)"
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gene"), F.expr(start).alias("start"), F.expr(f"{start} + cast(l_suppkey % 60 + 1 as int)").alias("end"))


def gene_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For each supplier two versions of a gene, the second with a deletion and other bases,
    the coding ranges of both, and three targets: with an insertion, shortened, and turned."""
    rows = merged_in_joins(spread(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select(F.col("s_suppkey").alias("aln_id"), F.expr(DNA.format(k="s_suppkey")).alias("s")))
    named = lambda *pairs: rows.select("aln_id", F.explode(F.array(*[F.struct(F.concat(F.lit(n), F.col("aln_id").cast("string")).alias("seq_id"), F.expr(e).alias("seq")) for n, e in pairs])).alias("x")).select("aln_id", "x.*")
    genes = named(("a", "s"), ("b", "concat(substring(s, 1, 60), replace(substring(s, 69), 'GAT', 'GTT'))"))
    ranges = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("start"), F.lit(b).alias("end")) for n, a, b in (("a", 10, 50), ("a", 70, 110), ("b", 10, 50), ("b", 62, 102))]))
    coding = rows.select("aln_id", ranges.alias("x")).select("aln_id", F.concat("x.n", F.col("aln_id").cast("string")).alias("seq_id"), F.concat(F.lit("cds_"), "x.n", F.col("aln_id").cast("string")).alias("cds_id"), "x.start", "x.end")
    targets = named(("t", "concat(substring(s, 1, 40), 'CATCATC', substring(s, 41))"), ("u", "substring(s, 20, 90)"), ("v", "reverse(translate(concat(substring(s, 1, 90), replace(substring(s, 91), 'TT', 'T')), 'ACGT', 'TGCA'))"))
    return genes, coding, targets


# The same tables for DuckDB, as common table expressions.
D_TARGETS = f"t AS (SELECT CAST(p_partkey AS VARCHAR) AS target_id, {DNA.format(k='p_partkey')} AS seq FROM part)"
D_MOLECULES = f"""m AS (SELECT CAST(s_suppkey AS VARCHAR) AS molecule, concat({DNA.format(k="concat('s',s_suppkey)")}, substring({DNA.format(k='s_suppkey')}, 1, 90)) AS seq FROM supplier)"""
D_HITS = """h AS (SELECT l_orderkey * 10 + l_linenumber AS hit_id, CAST(l_partkey AS VARCHAR) AS grna, CAST(l_suppkey AS VARCHAR) AS target_id,
 l_orderkey % 2000 AS "start", l_orderkey % 2000 + 20 AS "end", CASE WHEN l_linestatus = 'O' THEN '-' ELSE '+' END AS sense, 2100 AS target_len,
 CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS background, l_linestatus = 'F' AS feature, CAST(NULL AS BOOLEAN) AS extra FROM lineitem)"""
D_INTERVALS = """iv AS (SELECT user_id AS mol, CAST(floor(epoch(ts)) AS BIGINT) AS "start", CAST(floor(epoch(ts)) AS BIGINT) + 600 AS "end", value AS pident FROM events)"""
D_GENES = """ge AS (SELECT o_orderkey AS gene, o_orderkey % 1000 AS g_start, o_orderkey % 1000 + 1000 AS g_end, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders)"""
D_CODING = """cd AS (SELECT l_orderkey AS gene, 100 * l_linenumber + l_partkey % 50 AS "start", 100 * l_linenumber + l_partkey % 50 + l_suppkey % 60 + 1 AS "end" FROM lineitem)"""
D_GUIDES = """b AS (SELECT target_id, '+' AS strand, seq AS s FROM t UNION ALL SELECT target_id, '-', reverse(translate(seq,'ACGT','TGCA')) FROM t),
w AS (SELECT target_id, strand, s, unnest(range(0, length(s) - 19)) AS p FROM b),
g AS (SELECT target_id, strand, substring(s, p + 1, 20) AS grna, CASE strand WHEN '+' THEN p ELSE length(s) - p - 20 END AS "start" FROM w WHERE regexp_matches(substring(s, p + 21, 3), '^[ACGT]GG'))"""
