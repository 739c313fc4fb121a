"""Exact repeated substrings by prefix-free parsing.

A text is cut where the hash of its last ``TRIGGER`` bytes falls in a fixed residue
class.  Phrases overlap by the trigger, so no phrase's suffix of that length is a proper
prefix of another, and equal stretches of text are cut alike wherever they stand.  Every
start position of a window belongs to the first trigger that the window wholly holds, and
its place in corpus order is that of (phrase suffix before the trigger's end, rest of the
parse after it).  Only one question is asked of that order: do neighbours share
``window`` bytes?  So suffixes are held by classes of their first ``window`` bytes and
phrases of the parse by classes of their context, never by single comparisons:

1. a parse row for each trigger: C, the class of the context that all windows of the
   trigger have in common, and K, the class of all bytes that its windows cover;
2. a context seen once in the corpus repeats nowhere: most rows of ordinary text end here;
3. equal K: all windows of the rows repeat, whatever their number;
4. contexts with several K: one row of each K is expanded to the suffixes of its phrase,
   a class for each window, which gives the exact ends of the repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.scratch import stored

TRIGGER = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def rolled_hashes(data: bytes) -> np.ndarray:
    """The hash of data[i : i + TRIGGER] for every i."""
    if len(data) < TRIGGER:
        return np.empty(0, np.uint64)
    rolled = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), TRIGGER)
    return (np.ascontiguousarray(rolled).view("<u8")[:, 0] * _MIX) >> np.uint64(32)


def parse_rows(data: bytes, window: int) -> list[tuple[int, int, int]]:
    """(e, s, t): the windows that start at s..t belong to the trigger that ends at e.

    Every window start lies in exactly one row.  A window belongs to the first trigger
    that it wholly holds; a window that holds none (repetitive text) to the first place
    of the least hash in it.  Either depends on the window's bytes alone.  Rows are cut
    where more than 3/4 of the window lies before e.
    """
    last, split = len(data) - window, window * 3 // 4
    if last < 0:
        return []
    hashes = rolled_hashes(data)
    ends = (np.flatnonzero(hashes % np.uint64(max(2, window * 4 // 25)) == 0) + TRIGGER).tolist()
    rows, start = [], 0

    def add(e: int, stop: int) -> int:
        s = start
        if e - s > split:
            rows.append((e, s, min(stop, e - split - 1)))
            s = rows[-1][2] + 1
        if s <= stop:
            rows.append((e, s, stop))
        return stop + 1

    for e in [*ends, len(data) + window + TRIGGER]:
        while start <= last and e - start > window:  # no trigger in the window at start
            within = hashes[start : start + window - TRIGGER + 1]
            at = int(within.argmin())
            lower = np.flatnonzero(hashes[start + len(within) : e - TRIGGER] < within[at])
            stop = start + int(lower[0]) if len(lower) else last
            start = add(start + at + TRIGGER, min(last, start + at, stop, e - window - 1))
        stop = min(e - TRIGGER, last)
        if start <= stop:
            start = add(e, stop)
    return rows


def row_classes(data: bytes, rows: list[tuple[int, int, int]], window: int) -> tuple[list[int], list[int]]:
    """C and K of each row: the context in a place fixed by the trigger that all its
    windows hold, and all the bytes that they cover."""
    h, contexts, covers = xxhash.xxh3_64_intdigest, [], []
    quarter, split = window // 4, window * 3 // 4
    for e, s, t in rows:
        covers.append(h(data[s : t + window]) - 2**63)
        contexts.append((h(data[e - split : e], 2) if e - s > split else h(data[e - TRIGGER : e + quarter], 1)) - 2**63)
    return contexts, covers


#: Windows of a row that are first compared together.
BLOCK = 8


def window_blocks(data: bytes, e: int, s: int, t: int, window: int):
    """(s, t, c, k, classes) of the row's windows in blocks by distance from the trigger:
    the context that a whole block has in common, the bytes covered, and each window's class."""
    h = xxhash.xxh3_64_intdigest
    while s <= t:
        b = (e - s) // BLOCK
        stop = min(t, e - b * BLOCK)
        c = h(data[e - b * BLOCK : e - b * BLOCK - BLOCK + 1 + window], b)
        yield s, stop, c - 2**63, h(data[s : stop + window]) - 2**63, [h(data[p : p + window]) - 2**63 for p in range(s, stop + 1)]
        s = stop + 1


def repeated_spans(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, starts array<int>, ends array<int>): for each id with any, the maximal runs of
    byte positions covered by a ``window``-byte string that also starts anywhere else in
    the corpus, overlapping occurrences included.

    Ids must be distinct.  Null, empty and shorter texts have no runs.  Classes are 64-bit
    hashes of the bytes; there are no caps and no samples.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") >= window)
    kind = dict(texts.dtypes)["id"]

    def parse(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                part = b.slice(lo, 100)
                at, cols = [], ([], [], [], [], [])
                for row, data in enumerate(part.column(1)):
                    data = data.as_buffer().to_pybytes()
                    rows = parse_rows(data, window)
                    at.extend([row] * len(rows))
                    for col, new in zip(cols, (*([r[i] for r in rows] for i in range(3)), *row_classes(data, rows, window)), strict=True):
                        col.extend(new)
                types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *[pa.array(x, t) for x, t in zip(cols, types, strict=True)]], names=["id", "e", "s", "t", "c", "k"])

    parsed = texts.mapInArrow(parse, f"id {kind}, e int, s int, t int, c long, k long")
    shared = stored(parsed.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c"), "pfpctx")
    kept = stored(parsed.join(shared, "c"), "pfprows")
    covers = stored(kept.groupBy("c", "k").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "e", "s", "t")).alias("rep")), "pfpcover")
    several = covers.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c")
    equal = kept.join(covers.where("m > 1").select("c", "k"), ["c", "k"]).select("id", "s", "t")

    # one row of each cover in contexts with several: the same comparison for blocks of
    # its windows, and for single windows where blocks differ
    asked = covers.join(several, "c").select("rep.id", "rep.e", "rep.s", "rep.t", (F.col("m") == 1).alias("open"))
    asked = asked.groupBy("id").agg(F.collect_list(F.struct("e", "s", "t", "open")).alias("rows"))  # of one text

    def expand(batches):
        for b in batches:
            for row in range(b.num_rows):
                data = b.column(1)[row].as_buffer().to_pybytes()
                out = [(*x, r["open"]) for r in b.column(2)[row].as_py() for x in window_blocks(data, r["e"], r["s"], r["t"], window)]
                types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([row] * len(out), pa.int64())), *[pa.array(c, x) for c, x in zip(zip(*out, strict=True), types, strict=True)]], names=["id", "s", "t", "c", "k", "classes", "open"])

    blocks = stored(texts.join(asked, "id").select("id", "text", "rows").mapInArrow(expand, f"id {kind}, s int, t int, c long, k long, classes array<long>, open boolean"), "pfpblocks")
    same = stored(blocks.groupBy("c", "k").agg(F.count(F.lit(1)).alias("m"), F.max("open").alias("o")), "pfpsame")
    equal_blocks = blocks.where("open").join(same.where("m > 1 and o").select("c", "k"), ["c", "k"]).select("id", "s", "t")
    differing = same.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("o") & (F.col("m") == 1)).alias("o")).where("n > 1 and o").select("c")
    windows = stored(blocks.join(differing, "c").select("id", "s", F.posexplode("classes").alias("i", "h"), "open"), "pfpwin")
    twice = stored(windows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("o")).where("n > 1 and o").select("h"), "pfptwice")
    single = windows.where("open").join(twice, "h").select("id", (F.col("s") + F.col("i")).alias("s"), (F.col("s") + F.col("i")).alias("t"))

    def merge(batches):
        for b in batches:
            starts, ends = [], []
            for runs in b.column(1):
                pairs = np.array([(r["s"], r["t"]) for r in runs.as_py()], np.int64).reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                lo, hi = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] + window)
                new = np.r_[True, lo[1:] > hi[:-1]]
                starts.append(lo[new])
                ends.append(hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["id", "starts", "ends"])

    spans = equal.unionByName(equal_blocks).unionByName(single).groupBy("id").agg(F.collect_list(F.struct("s", "t")).alias("runs"))  # of one text
    return stored(spans.mapInArrow(merge, f"id {kind}, starts array<int>, ends array<int>"), "pfpspans").withColumnRenamed("id", id_col)


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells its rows apart: the id, or where ids repeat or are
    null a number given to each row and stored with it."""
    per = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    if per.where((F.col("n") > 1) | F.col(id_col).isNull()).isEmpty():
        return docs, id_col
    name = "row__"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "pfpdocs"), name


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` with span_starts__ and span_ends__ of their runs (null: none)."""
    return docs.join(spans.select(F.col(id_col).alias("span_id__"), F.col("starts").alias("span_starts__"), F.col("ends").alias("span_ends__")), docs[id_col] == F.col("span_id__"), "left").drop("span_id__")


def removal_digest(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes, n_chars, text) of each row:
    what is left of its text when the repeated runs go, n_chars and text without characters
    of which a run took a part.  A null text counts as empty.  Repeated rows are
    documents of their own, so each repeats the other's text, whatever their ids."""
    rows, key = numbered(docs.select(id_col, text_col), id_col)
    marked = with_spans(rows, repeated_spans(rows, window, key, text_col), key).select(id_col, text_col, "span_starts__", "span_ends__")

    def digest(batches):
        for b in batches:
            out = []
            for text, lo, hi in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                at, kept = 0, []
                for s, t in zip(lo or (), hi or (), strict=True):
                    kept.append(data[at:s])
                    at = t
                left = b"".join([*kept, data[at:]]) if kept else data
                rest = left.decode(errors="ignore") if kept else text.as_py() or ""
                out.append((len(data), len(data) - len(left), len(lo or ()), hashlib.sha256(left).hexdigest(), len(left), len(rest), rest))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 7, types, strict=True)]], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "n_chars", "text"])

    kind = dict(docs.dtypes)[id_col]
    return marked.mapInArrow(digest, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes long, n_chars long, text string")


def without_repeats(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated runs cut out of the text column; a character that only
    partly lies in a run stays whole.  Rows, other columns and their order stay.  Repeated
    rows are documents of their own, so each repeats the other's text."""
    rows, key = numbered(docs, id_col)
    marked = with_spans(rows, repeated_spans(rows, window, key, text_col), key).select(*docs.columns, "span_starts__", "span_ends__")
    names, where = docs.columns, docs.columns.index(text_col)

    def cut(batches):
        for b in batches:
            out = []
            for text, lo, hi in zip(b.column(where), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if not lo:
                    out.append(text.as_py())
                    continue
                data, at, kept = text.as_buffer().to_pybytes(), 0, []
                for s, t in zip(lo, hi, strict=True):
                    while s < t and data[s] & 0xC0 == 0x80:
                        s += 1
                    while t > s and t < len(data) and data[t] & 0xC0 == 0x80:
                        t -= 1
                    kept.append(data[at:s])
                    at = t
                out.append(b"".join([*kept, data[at:]]).decode())
            columns = [b.column(i) for i in range(b.num_columns - 2)]
            columns[where] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(cut, docs.schema)
