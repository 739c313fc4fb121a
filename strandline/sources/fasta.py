"""FASTA files read in byte ranges: a long record is cut into chunks by several tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.chunks import CHUNK
from strandline.operators.scratch import stored

#: Bases of a piece that a task hands on.
PIECE_BASES = 1 << 16
COLUMNS = {"file": pa.string(), "block": pa.int64(), "record": pa.int32(), "molecule": pa.string(), "at": pa.int64(), "piece": pa.string()}


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), COLUMNS.values(), strict=True)], names=list(COLUMNS))


def read_fasta_chunks(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """(molecule, chunk, base, part): the records' sequences in chunks of ``size`` bases.

    Files are split at line ends wherever Spark splits them, so a record of any length that
    stands on many lines is read by many tasks; the first lines of a split belong to the last
    record of the splits before it.  The id is the text up to white space.  Of equal ids the
    last wins, over files in the order of their paths and within a file.  Blank lines and
    lines before the first header are left out; records without bases have no row.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    kind = "file string, block long, record int, molecule string, at long, piece string"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a record's lines within a split; record 0 goes on from the split before."""
        split, record, name, at, held, bases, rows = None, 0, None, 0, [], 0, []

        def hand_on(last: bool) -> None:
            nonlocal at, held, bases
            if bases or last:  # a record's last piece stands for it even without bases
                rows.append((*split, record, name, at, "".join(held)))
                at, held, bases = at + bases, [], 0

        for b in batches:
            for file, block, line in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != split:
                    if split:
                        hand_on(True)
                    split, record, name, at = (file, block), 0, None, 0
                if line.startswith(">"):
                    hand_on(True)
                    record, name, at = record + 1, (line[1:].split(None, 1) or [""])[0], 0
                else:
                    line = "".join(line.split())
                    held.append(line)
                    bases += len(line)
                    if bases >= PIECE_BASES:
                        hand_on(False)
            if rows:
                yield batch(rows)
                rows = []
        if split:
            hand_on(True)
            yield batch(rows)

    found = stored(lines.mapInArrow(pieces, kind), "fasta")
    ends = found.groupBy("file", "block", "record").agg(F.max(F.col("at") + F.length("piece")).alias("bases"), F.first("molecule").alias("molecule"))
    # Two rows a split: its first part, which goes on from before, and its last record.
    edges = ends.groupBy("file", "block").agg(F.max(F.struct("record", "molecule", "bases")).alias("last"), F.max(F.when(F.col("record") == 0, F.col("bases"))).alias("first")).orderBy("file", "block").collect()
    carried, file, name, record, bases = [], None, None, -1, 0
    for e in edges:
        if e["file"] != file:
            file, name, record, bases = e["file"], None, -1, 0
        carried.append((e["file"], e["block"], record, name, bases))
        if e["last"]["record"] > 0:
            name, record, bases = e["last"]["molecule"], e["block"], e["last"]["bases"]
        else:
            bases += e["first"] or 0
    before = spark.createDataFrame(carried, "file string, block long, from_block long, from_name string, from_bases long")
    rows = found.join(F.broadcast(before), ["file", "block"])  # a row a split
    going = F.col("record") == 0
    rows = rows.select(
        "file", F.when(going, F.col("from_name")).otherwise(F.col("molecule")).alias("molecule"), F.when(going, F.col("from_block")).otherwise(F.col("block")).alias("born"),
        "record", "block", (F.col("at") + F.when(going, F.col("from_bases")).otherwise(0)).alias("at"), "piece",
    ).where("molecule is not null")
    # A record is known by where its header stands; what goes on belongs to its split's last one.
    lasts = found.groupBy("file", F.col("block").alias("born")).agg(F.max("record").alias("last"))
    rows = rows.join(lasts, ["file", "born"]).withColumn("number", F.when(going, F.col("last")).otherwise(F.col("record")))
    winner = rows.groupBy("molecule").agg(F.max(F.struct("file", "born", "number")).alias("w"))
    rows = rows.join(winner, "molecule").where((F.col("file") == F.col("w.file")) & (F.col("born") == F.col("w.born")) & (F.col("number") == F.col("w.number")) & (F.length("piece") > 0))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("at") / size).cast("int"), F.floor((F.col("at") + F.length("piece") - 1) / size).cast("int"))))
    base = F.col("chunk").cast("long") * size
    first = F.greatest(base - F.col("at"), F.lit(0).cast("long")).cast("int")
    last = F.least(base + size - F.col("at"), F.length("piece").cast("long")).cast("int")
    cut = rows.select("molecule", "chunk", F.struct("at", F.substr("piece", first + 1, last - first).alias("p")).alias("x"))
    joined = cut.groupBy("molecule", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), "").alias("part"))
    return joined.select("molecule", "chunk", (F.col("chunk").cast("long") * size).alias("base"), "part")
