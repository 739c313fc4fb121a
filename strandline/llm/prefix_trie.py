"""The prefix trie of conversations, merged from partial tries.

Turns become numbers early: a turn is two 64-bit hashes of its role and text, and a sequence
of turns is the sum of its turns' hashes, each stirred with its place.  Sums over a sorted,
range-partitioned table give every prefix its key without bringing a conversation into one
task.  Partitions combine the nodes of their prefixes, merges by key add up the members, and
sums over subtrees are rolled up along pointers to ancestors that double in length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.prefix import prefix_within
from strandline.operators.scratch import stored

#: Conversations of a block share the first turns of the block's first one.
BLOCK, MOST_SHARED = 100, 6
#: Partial tries that one task of a merge takes together.
FAN = 8
#: Bytes of a chunk of a node's ends.
CHUNK_BYTES = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _stirred(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    a = hashes.astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (a ^ (a >> np.uint64(31))).astype(np.int64)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, place, x, y, size): the turns of each rebuilt conversation by place (from 1), as
    two hashes and code points; and (conv): all conversations, those without turns too.

    The first h turns of conversation c come from that with number c - c % 100 (all if it has
    fewer, none if it is absent; the remainder has c's sign), h being the unsigned CRC-32 of c
    in decimal, modulo 6; its own turns after the first h follow.  Turns are ordered by turn (null first), then role and
    text.  Rows without conv_id take no part.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text"))
    rows = rows.withColumns({"x": F.xxhash64(F.lit(1), "role", "text"), "y": F.xxhash64(F.lit(2), "role", "text"), "size": F.length("text").cast("long")})
    own = prefix_within(rows, "conv", [F.asc_nulls_first("turn"), "role", "text"], [], ["conv", "x", "y", "size"])
    own = own.withColumn("nth", F.col("row_before") + 1).drop("row_before")
    shared = (F.crc32(F.col("conv").cast("string")) % MOST_SHARED).cast("long")
    convs = stored(own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumns({"base": F.col("conv") - F.col("conv") % BLOCK, "h": shared}), "convs")
    # At most 100 conversations look for a base, which has at most five rows here.
    heads = own.where((F.col("conv") % BLOCK == 0) & (F.col("nth") < MOST_SHARED)).select(F.col("conv").alias("base"), "nth", "x", "y", "size")
    taken = convs.join(heads, "base").where("nth <= h").select("conv", F.col("nth").alias("place"), "x", "y", "size")
    had = heads.groupBy("base").agg(F.count(F.lit(1)).alias("had"))
    shift = convs.join(had, "base", "left").select("conv", "h", F.least("h", F.coalesce("had", F.lit(0))).alias("had"))
    rest = own.join(shift, "conv").where("nth > h").select("conv", (F.col("nth") - F.col("h") + F.col("had")).alias("place"), "x", "y", "size")
    return taken.unionByName(rest), convs.select("conv")


def _prefixes(sequence: DataFrame) -> DataFrame:
    """(conv, place, x, y, px, py, size): keys of each prefix and of the one before it."""

    def stir(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column("place").to_numpy()
            new = [_stirred(b.column(c).to_numpy(), place) for c in ("x", "y")]
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("place"), pa.array(new[0]), pa.array(new[1]), b.column("size")], names=["conv", "place", "x", "y", "size"])

    stirred = sequence.select("conv", "place", "x", "y", "size").mapInArrow(stir, "conv long, place long, x long, y long, size long")
    summed = prefix_within(stirred, "conv", ["place"], ["x", "y"], ["conv", "place", "x", "y", "size"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = {c: b.column(c).to_numpy() for c in ("x", "y", "x_before", "y_before")}  # sums wrap
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("place"), pa.array(v["x"] + v["x_before"]), pa.array(v["y"] + v["y_before"]), pa.array(v["x_before"]), pa.array(v["y_before"]), b.column("size")], names=["conv", "place", "x", "y", "px", "py", "size"])

    return summed.select("conv", "place", "x", "y", "x_before", "y_before", "size").mapInArrow(add, "conv long, place long, x long, y long, px long, py long, size long")


PARTIAL = "place long, x long, y long, px long, py long, size long, n_convs long, conv long"


def _partial_tries(prefixes: DataFrame) -> DataFrame:
    """One row for each node of a batch of prefixes: members counted, their smallest id."""
    names = [c.split()[0] for c in PARTIAL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b]).group_by(["place", "x", "y"]).aggregate([("px", "min"), ("py", "min"), ("size", "min"), ("conv", "count"), ("conv", "min")])
                t = t.select(["place", "x", "y", "px_min", "py_min", "size_min", "conv_count", "conv_min"]).rename_columns(names)
                yield from t.to_batches()

    return prefixes.mapInArrow(run, PARTIAL)


def _merged(partial: DataFrame, by: list[str | Column]) -> DataFrame:
    return partial.groupBy("place", "x", "y", *by).agg(F.min("px").alias("px"), F.min("py").alias("py"), F.min("size").alias("size"), F.sum("n_convs").alias("n_convs"), F.min("conv").alias("conv"))


def _ends(last: DataFrame) -> DataFrame:
    """(place, x, y, ends_sha256): SHA-256 of the ids that end at a node, ascending, joined by
    commas.  Ids are sorted over all partitions, each makes chunks of text of its nodes' ids,
    and a node's chunks stream through one hash in order."""
    keys = ["place", "x", "y"]
    parts = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = last.repartitionByRange(parts, *keys, "conv").sortWithinPartitions(*keys, "conv")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_numpy() for c in (*keys, "conv")]
            if not len(cols[0]):
                continue
            edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            ids, rows = cols[3].tolist(), []
            step = CHUNK_BYTES // 20
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)], strict=True):
                for at in range(lo, hi, step):
                    part = ids[at : min(at + step, hi)]
                    rows.append((*(int(c[lo]) for c in cols[:3]), part[0], ",".join(map(str, part))))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names=[*keys, "least", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, rows = None, None, []
        for b in batches:
            for *now, ids in zip(*(b.column(c).to_pylist() for c in (*keys, "ids")), strict=True):
                if now != key:
                    if key:
                        rows.append((*key, h.hexdigest()))
                    key, h = now, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip([*keys, "ends_sha256"], r, strict=True)) for r in rows])
                rows = []
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip([*keys, "ends_sha256"], (*key, h.hexdigest()), strict=True))])

    made = ordered.mapInArrow(chunks, "place long, x long, y long, least long, ids string")
    return made.repartition(parts, *keys).sortWithinPartitions(*keys, "least").mapInArrow(digest, "place long, x long, y long, ends_sha256 string")


def _rolled_up(nodes: DataFrame) -> DataFrame:
    """``nodes`` (id, up: the parent's id or null, leaves, saved) with leaves and saved summed
    over each one's subtree.  After k rounds a node has the sums of those less than 2^k below
    it, and ``up`` points 2^k above; rounds end when no pointer is left."""
    table = stored(nodes, "rollup")
    while not table.where("up is not null").isEmpty():
        below = table.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = table.select(F.col("id").alias("up"), F.col("up").alias("next")).where("next is not null")
        grown = table.join(below, "id", "left").select("id", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        table = stored(grown.join(above, "up", "left").select("id", F.col("next").alias("up"), "leaves", "saved"), "rollup")
    return table.select("id", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256): the nodes of the trie of rebuilt conversations (see ``rebuilt``) from the
    table (conv_id, turn, role, text); a null role or text is empty.

    A node is a distinct sequence of first turns, named by its smallest member and its depth;
    the root has every conversation.  saved_tokens sums (members - 1) times the code points of
    the last text over a node's subtree, n_leaves its childless nodes.  No conversations make
    no nodes.  Sequences are told apart by 128 bits of hash and their length.
    """
    sequence, convs = rebuilt(turns)
    prefixes = stored(_prefixes(sequence), "prefixes")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0")
    zero = [F.lit(0).cast("long").alias(c) for c in ("place", "x", "y", "px", "py", "size")]
    # Partial tries of a batch, then of FAN partitions together, then all.
    partial = _partial_tries(prefixes).withColumn("group", F.floor(F.spark_partition_id() / FAN))
    nodes = _merged(_merged(partial, ["group"]).drop("group"), []).select("place", "x", "y", "px", "py", "size", "n_convs", "conv")
    nodes = stored(nodes.unionByName(root.select(*zero, "n_convs", "conv")).withColumn("id", F.struct("place", "x", "y")).drop("place", "x", "y"), "nodes")
    last = prefixes.groupBy("conv").agg(F.max(F.struct("place", "x", "y")).alias("e"))
    last = convs.join(last, "conv", "left").select("conv", *[F.coalesce(F.col(f"e.{c}"), F.lit(0)).alias(c) for c in ("place", "x", "y")])
    ends = _ends(last).select(F.struct("place", "x", "y").alias("id"), "ends_sha256")
    up = F.when(F.col("id.place") > 0, F.struct((F.col("id.place") - 1).alias("place"), F.col("px").alias("x"), F.col("py").alias("y")))
    nodes = nodes.withColumn("up", up)
    children = nodes.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    sums = _rolled_up(nodes.select("id", "up", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")))
    parents = nodes.select(F.col("id").alias("up"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(sums, "id").join(ends, "id", "left").join(parents, "up", "left")
    return out.select(F.col("conv").alias("conv_id"), F.col("id.place").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
