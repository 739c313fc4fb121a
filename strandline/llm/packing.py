"""Sequence packing as a cutting-stock problem solved by column generation."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.prefix import global_prefix
from strandline.operators.scratch import stored

#: Distinct words after which the words met before the last so many are forgotten.
REMEMBERED = 600_000
#: Marks that end words; no splitting pattern cuts a run of them.
MARKS = ".,;:!?%&#$*"


class WordIds:
    """Ids of whole texts as little-endian 32-bit bytes, by tokenizers.

    Plain Latin texts are lower-cased and cut by the file's own splitting pattern, and
    only words not met before go to the library, many in one call, told apart by the ids that
    end words.  Any other text (characters beyond U+024F, controls, special strings) is
    given to the library whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unusual = re.compile("[^\\t\\n\\r -~\u00a0-\u012f\u0131-\u024f]")
        #: words, and the parts of words, which read the same when they stand alone: those
        #: met of late, and those met before them
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        ends = [i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]
        self.ends = np.zeros(max(self.tokenizer.get_vocab_size(), *ends) + 1, bool)
        self.ends[ends] = True

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, found, missing = self.known, [], set()
        get = known.get
        for t in texts:
            if self.unusual.search(t) or any(s in t for s in self.special):
                found.append((None, ()))
                continue
            words = t.lower().split()
            ids = list(map(get, words))
            if None in ids:
                new = [w for w, x in zip(words, ids, strict=True) if x is None]
                missing.update(new)
                found.append((words, None))
            else:
                found.append((words, ids))
        again = missing & self.older.keys()
        known.update({w: self.older[w] for w in again})
        # letters alone are one part, letters and then marks are two
        cut = {}
        for w in missing - again:
            core = w.rstrip(MARKS)
            cut[w] = self.words.findall(w) if not core.isalpha() else () if len(core) == len(w) else (core, w[len(core) :])
        self.learn(list({p for w, ps in cut.items() for p in ps or (w,)}.difference(known)))
        whole, at = self.whole, known.__getitem__
        known.update({w: b"".join(map(at, ps)) for w, ps in cut.items() if len(ps) > 1})
        return [whole(t) if ws is None else b"".join(ids if ids is not None else map(at, ws)) for t, (ws, ids) in zip(texts, found, strict=True)]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Ids of words of one part each: the last id of a word is one that ends words."""
        for i in range(0, len(words), 5_000):
            part = words[i : i + 5_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenized_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Each document's ids and ``end_id``, cut from the front into full pieces and a rest."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches):
        v, tail = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                out = []
                for i, ids in zip(part.column(0).to_pylist(), v.encode(part.column(1).to_pylist()), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    for s in range(0, n, length):
                        piece = ids[4 * s : 4 * (s + length)]
                        out.append((i, s, len(piece) // 4, zlib.crc32(piece), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (part.schema.field(0).type, *[pa.int64()] * 4), strict=True)], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(cut, f"id {dict(rows.dtypes)['id']}, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: item b (1..capacity) weighs b and is worth value[b-1]."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = value[:c] + best[c - 1 :: -1]
        k = int(np.argmax(gain))
        best[c], pick[c] = (gain[k], k + 1) if gain[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern, c = np.zeros(capacity, np.int64), capacity
    while c > 0:
        if pick[c]:
            pattern[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def column_generation(demand: np.ndarray, capacity: int, gap: float = 0.001, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns (pieces of each size in one bin) and how often to use each, from the
    linear program min sum x subject to patterns covering ``demand``; sizes are 1..capacity.

    Revised simplex: start from patterns of one size each, price new ones by a knapsack
    over the dual values, and stop when the best is worth at most 1 + ``gap`` bins (the
    program's value is then within that share of its optimum), or after ``rounds``;
    the solution is feasible throughout.
    """
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return []
    per_bin = capacity // sizes
    basis = [np.bincount([s - 1], [k], capacity).astype(np.int64) for s, k in zip(sizes, per_bin, strict=True)]
    inverse, x = np.diag(1.0 / per_bin), demand[sizes - 1] / per_bin
    for _ in range(rounds):
        dual = inverse.sum(axis=0)  # every pattern costs one bin
        value = np.zeros(capacity)
        value[sizes - 1] = np.maximum(dual, 0)
        worth, pattern = best_pattern(value, capacity)
        if worth <= 1 + gap:
            break
        step = inverse @ pattern[sizes - 1]
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        r = int(np.argmin(ratio))
        if not np.isfinite(ratio[r]):
            break
        theta = ratio[r]
        x = x - theta * step
        x[r] = theta
        inverse[r] /= step[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(step[others], inverse[r])
        basis[r] = pattern
    return list(zip(basis, np.maximum(x, 0), strict=True))


def plan_bins(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, uses) that together take exactly ``demand``: the linear program's
    patterns rounded down, then the remaining few pieces by first fit decreasing."""
    left, plan = demand.copy(), []
    for pattern, x in column_generation(demand, capacity):
        used = np.flatnonzero(pattern)
        n = min(int(x + 1e-6), int((left[used] // pattern[used]).min()))
        if n > 0:
            plan.append((pattern, n))
            left -= n * pattern
    while left.any():
        room, pattern = capacity, np.zeros(capacity, np.int64)
        for s in np.flatnonzero(left)[::-1] + 1:
            k = min(int(left[s - 1]), room // int(s))
            pattern[s - 1] += k
            room -= k * int(s)
        used = np.flatnonzero(pattern)
        n = int((left[used] // pattern[used]).min())
        plan.append((pattern, n))
        left -= n * pattern
    return plan


def packed_sequences(docs: DataFrame, tokenizer: str, length: int = 2048, grain: int = 8, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``length`` ids.

    A document's ids end with ``end_id`` (null or empty text: that id alone).  Longer
    documents are cut into full sequences and a rest.  Lengths are rounded up to a
    multiple of ``grain`` for the histogram that the linear program sees (it has
    length / grain rows however many documents there are), so a piece wastes less than
    ``grain`` ids.  Pieces are ranked within their size by global prefix sums and take
    the slots of the rounded patterns in order.  Repeated rows are packed each.

    Returns a row a piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).
    """
    if length % grain:
        raise ValueError("grain must divide length")
    capacity = length // grain
    pieces = tokenized_pieces(docs, tokenizer, length, end_id, id_col, text_col)
    # stored: the range sort reads its input twice, the texts are tokenized once
    pieces = stored(pieces.withColumn("size", F.ceil(F.col("length") / grain).cast("int")), "pieces")
    ranked = global_prefix(pieces, ["size", "id", "start"], [])
    demand, first = np.zeros(capacity, np.int64), np.zeros(capacity + 1, np.int64)
    for r in ranked.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.min("row_before").alias("first")).collect():
        demand[r["size"] - 1], first[r["size"]] = r["n"], r["first"]

    # slots[size]: runs of ranks that go to one pattern, `each` of them to a sequence
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken, base = np.zeros(capacity, np.int64), 0
    for pattern, uses in plan_bins(demand, capacity):
        for s in np.flatnonzero(pattern):
            runs.setdefault(int(s) + 1, []).append((int(taken[s]), int(pattern[s]), base))
            taken[s] += uses * pattern[s]
        base += uses
    tables = {s: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for s, v in runs.items()}

    def place(frames):
        for f in frames:
            size, rank = f["size"].to_numpy(), f["row_before"].to_numpy() - first[f["size"].to_numpy()]
            out = np.empty(len(f), np.int64)
            for s in np.unique(size):
                starts, each, bases = tables[int(s)]
                at = np.flatnonzero(size == s)
                k = np.searchsorted(starts, rank[at], "right") - 1
                out[at] = bases[k] + (rank[at] - starts[k]) // each[k]
            yield pd.DataFrame({"id": f["id"], "start": f["start"], "length": f["length"], "ids_crc32": f["ids_crc32"], "doc_tokens": f["doc_tokens"], "sequence_id": out})

    kind = dict(ranked.dtypes)["id"]
    placed = ranked.mapInPandas(place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    # a sequence holds at most `length` pieces, so these windows are small
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long").alias("offset"),
    )
