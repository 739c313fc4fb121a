"""Queries of whole designs, with the SQL of what it can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.parameters import Design
from strandline.operators import design as des
from strandline.plans import substrate as sub
from strandline.plans.registry import big, query


def _background(spark, d):
    return sub.molecules(spark, d).select(F.lit("suppliers").alias("source"), "molecule", "seq")


@query(f"""WITH {sub.D_TARGETS}, {sub.D_MOLECULES}, {sub.D_GUIDES}, mb AS (SELECT seq AS s FROM m UNION ALL SELECT reverse(translate(seq,'ACGT','TGCA')) FROM m),
 mw AS (SELECT DISTINCT substring(s, p + 1, 20) AS x FROM (SELECT s, unnest(range(0, length(s) - 19)) AS p FROM mb)),
 gu AS (SELECT grna, count(DISTINCT target_id) AS n_targets FROM g GROUP BY grna)
 SELECT grna, n_targets, length(replace(replace(grna,'A',''),'T','')) / 20 BETWEEN 0.3 AND 0.7 AS "GC", x IS NULL AS background FROM gu LEFT JOIN mw ON x = grna""")
def design_guides(spark, d):
    """All candidates of a design with the default parameters, with their checks."""
    guides, hits = des.candidates(sub.targets(spark, d), Design())
    checked = des.screened(guides.withColumn("GC", des.sq.gc_content(F.col("grna")).between(0.3, 0.7)), _background(spark, d), Design(), sub.targets(spark, d).select(F.col("target_id").alias("seq_id"), "seq"))
    per = hits.groupBy("grna").agg(F.countDistinct("target_id").alias("n_targets"))
    return per.join(checked, "grna").select("grna", *big("n_targets"), "GC", "background")


@query()
def design_sets(spark, d):
    """Sets of a design in which a guide fails with one mismatch or fewer beside the motif,
    over the targets that passing guides hit."""
    design = Design(offtarget_mismatch=2, offtarget_pamless=False, accept_unset=True, cover_reachable=True)
    return des.designed(sub.targets(spark, d), design, _background(spark, d)).sets
