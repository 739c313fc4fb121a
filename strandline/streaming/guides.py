"""Guides of targets that keep arriving: on the fly, and numbered once in a growing table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.functions.pam import Pam
from strandline.operators.prefix import global_prefix
from strandline.operators.sequences import exact_occurrences, gc_content, guides

TABLE = "grna string, grna_id string, number long, target_id string, background boolean, batch long"


def guide_stream(targets: DataFrame, pam: Pam, gc_min: float = 0.3, gc_max: float = 0.7) -> DataFrame:
    """``targets`` (target_id, seq), static or streaming; guides with their GC check."""
    return guides(targets, pam).withColumn("gc_ok", F.round(gc_content(F.col("grna")), 6).between(gc_min, gc_max))


def numbered_guides(targets: DataFrame, pam: Pam, background: DataFrame, path: str, checkpoint: str, prefix: str = "gRNA", **trigger) -> StreamingQuery:
    """Start a stream that writes each guide of the streaming ``targets`` (target_id, seq) once
    to Parquet under ``path``: (grna, grna_id, number, target_id, background, batch).

    The stream's state holds the guides met so far, so one that comes again with a later
    target has no second row; the target is the first of its batch, by id and place.  Numbers
    go on from batch to batch, within a batch by target and place.  ``background`` is true
    unless the guide stands in the static molecules (molecule, seq).  A batch is written to a
    folder of its own and its numbers follow from the folders of earlier ones, so a batch that
    is run again after a failure replaces what it wrote.
    """
    found = guides(targets, pam).select("grna", "target_id", "start", "strand")
    length = pam.length

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        first = rows.groupBy("grna").agg(F.min(F.struct("target_id", "start", "strand")).alias("o"))
        rows = global_prefix(first, ["o", "grna"], [])
        earlier = spark.read.schema(TABLE).option("recursiveFileLookup", True).parquet(path) if batch else spark.createDataFrame([], TABLE)
        used = earlier.where(F.col("batch") < batch).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
        stands = exact_occurrences(rows.select(F.col("grna").alias("query")), background, length).select(F.col("query").alias("grna"), F.lit(False).alias("x")).distinct()
        number = F.col("row_before") + 1 + used
        out = rows.join(stands, "grna", "left").select("grna", F.format_string(f"{prefix}_%03d", number).alias("grna_id"), number.alias("number"), "o.target_id", F.coalesce("x", F.lit(True)).alias("background"), F.lit(batch).cast("long").alias("batch"))
        out.write.mode("overwrite").parquet(f"{path}/written-{batch:09d}")

    return found.dropDuplicates(["grna"]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
