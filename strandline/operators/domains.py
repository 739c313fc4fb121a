"""Domains found by position-specific score matrices over translated sequences.

A window whose score reaches the threshold has, among the words of five (or three) residues
that a matrix is cut into, one that reaches its share of it.  Words that do are listed for each
matrix and meet the peptides' words by equality, in groups of some matrices and some peptides;
windows met are scored there, and left as soon as they cannot reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.homology import COMPLEMENT
from strandline.operators.joins import merged_in_joins
from strandline.operators.scratch import stored
from strandline.operators.sequences import genetic_code

#: Positions of a matrix at most; of all matrices, and residues of all peptides, of a group; and
#: windows looked at together.
LONGEST, POSITIONS, PEPTIDES, MET = 16_384, 163_840, 25_000_000, 262_144
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
WORD = 3
#: Lengths of words, the longest first, and how many of a longer one may reach its share.
WORDS, MOST_SEEDS = (5, WORD), 16_384
#: Parameters of the distribution of the best score without gaps.
RATE, WEIGHT = 0.3176, 0.134


def six_frames(sequences: DataFrame, code: int = 1, both: bool = True) -> DataFrame:
    """(target_id, strand, frame, n, peptide): ``sequences`` (target_id, seq) of n bases read in
    three frames, and of the other strand too unless ``both`` is false.  X stands for codons
    with other letters than A, C, G and T (or U); an unfinished last codon is left out."""
    table = genetic_code(code)
    amino = {"".join(c): table[i] for i, c in enumerate(product("ACGT", repeat=3))}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seq = (seq or "").upper().replace("U", "T")
                for strand, s in (("+", seq), ("-", seq.translate(COMPLEMENT)[::-1]))[: 2 if both else 1]:
                    rows += [(name, strand, f, len(seq), "".join([amino.get(s[i : i + 3], "X") for i in range(f, len(s) - 2, 3)])) for f in range(3)]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["target_id", "strand", "frame", "n", "peptide"])

    return sequences.select(F.col("target_id").cast("string"), "seq").mapInArrow(read, "target_id string, strand string, frame int, n int, peptide string")


def _reaching(word: np.ndarray, share: float, room: int) -> np.ndarray | None:
    """Rows of residues (the last code is any other letter) whose summed scores reach ``share``;
    None where they are more than ``room``."""
    rest = np.append(np.cumsum(word.max(1)[::-1])[::-1], 0.0)
    sums, rows = np.zeros(1), np.zeros((1, 0), np.int8)
    for i, scores in enumerate(word):
        total = sums[:, None] + scores
        r, c = np.nonzero(total + rest[i + 1] >= share - 1e-9)
        if len(r) > room:
            return None
        sums, rows = total[r, c], np.hstack([rows[r], c[:, None].astype(np.int8)])
    return rows


def _seeds(m: np.ndarray, least: float) -> list[tuple[int, np.ndarray]]:
    """The words of a matrix that reach their share, as rows of residues at their first position, of
    the longest length of ``WORDS`` at which they are not too many: longer ones are met less by chance."""
    for size in WORDS:
        words, found = len(m) // size, []
        # What the residues behind the last word can add at most is taken off.
        share = (least - np.maximum(m[words * size :].max(1, initial=-np.inf), 0).sum()) / words if words else np.inf
        for w in range(words):
            rows = _reaching(m[w * size : (w + 1) * size], share, MOST_SEEDS if size > WORD else (len(RESIDUES) + 1) ** WORD)
            if rows is None:
                break
            found.append((w * size, rows))
        if words and len(found) == words:
            return found
    return []


def _words(matrices: DataFrame) -> DataFrame:
    """(domain, size, off, seed): the words of each matrix that reach their share (see ``_seeds``)."""
    letters_ = np.array(list(RESIDUES + "X"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m = np.array(r["scores"], float).reshape(-1, len(RESIDUES))
                for at, rows in _seeds(np.hstack([m, np.full((len(m), 1), -4.0)]), r["least"]):
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([r["domain"]] * n, pa.string()), pa.array([len(m)] * n, pa.int32()), pa.array([at] * n, pa.int32()), pa.array(["".join(x) for x in letters_[rows]], pa.string())], names=["domain", "size", "off", "seed"])

    return matrices.select("domain", "least", "scores").mapInArrow(read, "domain string, size int, off int, seed string")


def _with_words(table: DataFrame) -> DataFrame:
    """``table`` (domain, size, scores, least) with the words of each matrix (see ``_seeds``): their
    length, and of each its residues as one number and its first position in the matrix."""
    kind = "domain string, size int, scores array<double>, least double, word int, seeds array<int>, offs array<int>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            added = []
            for size, scores, least in zip(*(b.column(c).to_pylist() for c in ("size", "scores", "least")), strict=True):
                m = np.hstack([np.array(scores, float).reshape(size, -1), np.full((size, 1), -4.0)])
                found = [(at, rows) for at, rows in _seeds(m, least) if len(rows)]
                k = found[0][1].shape[1] if found else WORD
                codes = [rows.astype(np.int32) @ ((len(RESIDUES) + 1) ** np.arange(k)[::-1]).astype(np.int32) for _, rows in found]
                added.append((k, np.concatenate([np.empty(0, np.int32), *codes]), np.concatenate([np.empty(0, np.int32), *[np.full(len(rows), at, np.int32) for at, rows in found]])))
            words, seeds, offs = zip(*added, strict=True) if added else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("domain", "size", "scores", "least")), pa.array(words, pa.int32()), pa.array(seeds, pa.list_(pa.int32())), pa.array(offs, pa.list_(pa.int32()))], names=[x.split()[0] for x in kind.split(", ")])

    return table.select("domain", "size", "scores", "least").mapInArrow(read, kind)


def domain_hits(matrices: DataFrame, peptides: DataFrame, expect: float = 0.01) -> DataFrame:
    """(domain, target_id, strand, frame, at, size, score): windows of ``peptides`` (see
    ``six_frames``) as long as a matrix whose summed scores are expected by chance ``expect``
    times at most, all of them; at counts residues from 0.

    ``matrices`` (domain, pos, residue, score) name scores by position from 0; residues not
    named score -4, and so do X and stops.  Gaps and parts of a domain are not searched.
    Matrices have 3 to ``LONGEST`` positions; shorter ones are left out, longer ones refused.
    """
    place = F.instr(F.lit(RESIDUES), F.col("residue")) - 1
    known = matrices.where((F.length("residue") == 1) & (place >= 0)).select(F.col("domain").cast("string").alias("domain"), F.col("pos").cast("int").alias("pos"), place.alias("place"), F.col("score").cast("double").alias("score"))
    sized = known.groupBy("domain").agg((F.max("pos") + 1).alias("size"), F.map_from_entries(F.collect_set(F.struct((F.col("pos") * len(RESIDUES) + F.col("place")).alias("k"), "score"))).alias("m")).where(f"size >= {WORD}")
    sized = sized.withColumn("size", F.when(F.col("size") <= LONGEST, F.col("size")).otherwise(F.raise_error(F.lit("a matrix has too many positions"))))
    scores = F.transform(F.sequence(F.lit(0), F.col("size") * len(RESIDUES) - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(-4.0)))
    residues = peptides.agg(F.sum(F.length("peptide"))).first()[0] or 0
    least = (F.log(F.col("size") * F.lit(float(max(residues, 1)) * WEIGHT)) - log(expect)) / RATE
    table = sized.select("domain", "size", scores.alias("scores"), least.alias("least"))
    keep = ["target_id", "strand", "frame"]
    table = stored(_with_words(table), "matrices")
    blocks = (table.agg(F.sum("size")).first()[0] or 0) // POSITIONS + 1
    parts = max(residues // PEPTIDES + 1, -(-int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))
    dealt = lambda df: df.repartition(blocks * parts, "block", "part").groupBy("block", "part")
    some = table.select(F.pmod(F.hash("domain"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), *table.columns)
    texts = peptides.where(F.length("peptide") >= WORD).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.hash(*keep), F.lit(parts)).alias("part"), *keep, "peptide")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            for domain, row, at, size, total in _scored(left, right["peptide"].combine_chunks()):
                found.append(pa.table([left["domain"].take(pa.array(domain)), *(right[c].take(pa.array(row)) for c in keep), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(total)], names=["domain", *keep, "at", "size", "score"]))
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        return pa.concat_tables(found).combine_chunks() if found else pa.table([pa.array([], t) for t in kinds], names=["domain", *keep, "at", "size", "score"])

    return dealt(some).cogroup(dealt(texts)).applyInArrow(score, "domain string, target_id string, strand string, frame int, at int, size int, score double")


def _scored(matrices: pa.Table, peptides: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of ``matrices`` (see ``_with_words``) and of ``peptides``, places, sizes and scores of all
    windows whose scores reach the matrix's least."""
    other = len(RESIDUES)
    code = np.full(256, other, np.int32)
    code[np.frombuffer(RESIDUES.encode(), np.uint8)] = np.arange(other)
    ends = np.cumsum(np.array([0, *pc.binary_length(peptides).to_numpy()]))
    letter = code[np.frombuffer("".join(peptides.to_pylist()).encode(), np.uint8)]
    row = np.repeat(np.arange(len(peptides), dtype=np.int32), np.diff(ends))
    sizes, least = matrices["size"].to_numpy(), matrices["least"].to_numpy()
    whole = matrices["scores"].combine_chunks().flatten().to_numpy().reshape(-1, other)
    whole, base = np.hstack([whole, np.full((len(whole), 1), -4.0)]), np.cumsum(sizes) - sizes
    tables, flat = np.split(whole, base[1:]), whole.ravel()
    # What all positions from one on can add at most.
    rest = np.concatenate([np.cumsum(t.max(1)[::-1])[::-1] for t in tables])
    lengths, seeds, offs = matrices["word"].to_numpy(), matrices["seeds"].combine_chunks(), matrices["offs"].combine_chunks()
    hits = []
    for k in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == k)
        seed, off = (x.take(pa.array(mine)).flatten().to_numpy() for x in (seeds, offs))
        domain = np.repeat(mine, seeds.value_lengths().to_numpy()[mine])
        order = np.argsort(seed, kind="stable")
        domain, off = domain[order], off[order]
        count = np.bincount(seed, minlength=(other + 1) ** k)
        begin = np.cumsum(count) - count
        last = len(letter) - k + 1
        word = np.zeros(max(last, 0), np.int32)
        for j in range(k):
            word = word * np.int32(other + 1) + letter[j : j + last]
        places = np.flatnonzero(count[word])
        places = places[places + k <= ends[row[places] + 1]]
        times = count[word[places]]
        upto = np.cumsum(times)
        lo = 0
        while lo < len(places):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + MET, "right")))
            n = times[lo:hi]
            at = np.repeat(places[lo:hi], n)
            of = np.arange(len(at)) + np.repeat(begin[word[places[lo:hi]]] - (np.cumsum(n) - n), n)
            d, r = domain[of], row[at]
            at = at - off[of]
            inside = (at >= ends[r]) & (at + sizes[d] <= ends[r + 1])
            d, at = d[inside], at[inside]
            total, p = np.zeros(len(d)), 0
            done = []
            while len(d):
                ready = sizes[d] == p
                good = ready & (total >= least[d] - 1e-6)
                if good.any():
                    done.append((d[good], at[good]))
                open_ = ~ready if p % 5 else ~ready & (total + rest[np.minimum(base[d] + p, len(rest) - 1)] >= least[d] - 1e-6)
                d, at, total = d[open_], at[open_], total[open_]
                total += flat[(base[d] + p) * (other + 1) + letter[at + p]]
                p += 1
            hits += done
            lo = hi
    if hits:
        pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*hits, strict=True)], 1), axis=0)
        for i in np.unique(pairs[:, 0]).tolist():
            at = pairs[pairs[:, 0] == i, 1]
            total = tables[i][np.arange(sizes[i]), letter[at[:, None] + np.arange(sizes[i])]].sum(1)
            good = total >= least[i]
            at, total = at[good], total[good]
            yield np.full(len(at), i), row[at], at - ends[row[at]], np.full(len(at), sizes[i]), total


def domain_ranges(hits: DataFrame, peptides: DataFrame) -> DataFrame:
    """(domain, target_id, strand, start, end, score): the hits' places in bases of the + strand."""
    sizes = peptides.select("target_id", "n").distinct()
    first = F.col("frame") + 3 * F.col("at")
    last = first + 3 * F.col("size")
    placed = hits.join(merged_in_joins(sizes), "target_id")
    start = F.when(F.col("strand") == "+", first).otherwise(F.col("n") - last)
    end = F.when(F.col("strand") == "+", last).otherwise(F.col("n") - first)
    return placed.select("domain", "target_id", "strand", start.alias("start"), end.alias("end"), "score")
