"""Connected components of a link table, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.scratch import stored


#: Links of a file; rounds never have more links than the one before.
FILE_ROWS = 500_000


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b): the smallest id reachable.

    Alternates large-star and small-star steps (each a grouped minimum and a join back,
    so that a hub of any degree is pre-aggregated and its rows can be split) until the
    links are stars around their minima.  Rounds grow with the logarithm of the size.
    """
    star = stored(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )
    before, files = None, None
    while True:
        both = star.select("u", "v").unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        star = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        star = stored(star.coalesce(files) if files else star, "cc")
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, files = now, now[0] // FILE_ROWS + 1
    roots = star.select(F.col("v").alias("id")).distinct()
    return star.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
