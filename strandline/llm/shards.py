"""Contiguous, size-balanced shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.prefix import global_prefix


def balanced_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Cut the corpus, ordered by text checksum and id, at equal byte targets.

    A row's size is the UTF-8 bytes of its text plus ``overhead`` (null: only that).
    A row goes to the shard in which its first byte falls, so a shard's size differs
    from the mean by less than one document.  Equal texts stand next to each other:
    a group of copies lies in one shard or in neighbouring ones.  A single document
    larger than a shard's share leaves the shards that it spans empty.

    Returns (id, size, text_crc32, law, shard, slot, grown_shard); law is ``bytes``.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text).alias("crc"))
    placed = global_prefix(sized, ["crc", "size", "id"], ["size"])
    total = placed.agg(F.max(F.col("size_before") + F.col("size"))).first()[0] or 1
    # whole-number arithmetic in decimals: exact at any corpus size
    at = F.floor(F.col("size_before").cast("decimal(28,0)") * shards / F.lit(total).cast("decimal(28,0)"))
    placed = placed.withColumn("shard", F.least(at.cast("int"), F.lit(shards - 1)))
    first = placed.groupBy("shard").agg(F.min("row_before").alias("first_row"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("row_before") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
