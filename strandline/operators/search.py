"""Alignment hits: merging, ranking, overlap with features, and off-target tests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.pam import Pam
from strandline.operators.joins import merged_in_joins
from strandline.operators.ranges import merged, range_join
from strandline.operators.scratch import stored
from strandline.operators.sequences import letters, reverse_complement, windows

#: Bases by which sequences to be masked are looked up: the most that a sequence has, or all
#: of one that is shorter.
SEEDS = (8, 12, 16, 24)
#: The letter at which the bases to look up begin, in sequences that all have it early enough.
MARK = "G"
#: Letters with a code of three bits of their own, and how many of them a long holds.
LETTERS, CODE = "ACGTUN-", 21
#: Letters by which guides and windows are dealt, rows so dealt that a task meets, and pairs looked at
#: together.
SEED, SEEDED, MET = 4, 250_000, 262_144


def merged_hits(hits: DataFrame, keys: Sequence[str], within: int, min_len: int, min_id: float, id_before: float | None = None) -> DataFrame:
    """Hits of a molecule joined within a distance; kept if long and similar enough."""
    use = hits if id_before is None else hits.where(F.col("pident") >= id_before)
    out = merged(use, keys, within, [F.max("pident").alias("max_pident"), F.count(F.lit(1)).alias("n_hits")])
    return out.where((F.col("end") - F.col("start") >= min_len) & (F.col("max_pident") >= min_id))


def top_with_ties(hits: DataFrame, key: str, metric: str, n: int) -> DataFrame:
    rank = F.rank().over(Window.partitionBy(key).orderBy(F.desc(metric)))
    return hits.withColumn("rank__", rank).where(F.col("rank__") <= n).drop("rank__")


def overlap_all(hits: DataFrame, features: DataFrame, keys: Sequence[str], bin_size: int = 1000) -> DataFrame:
    """Every hit with each feature that it overlaps and the overlap's length; 0 for none."""
    pairs = range_join(hits, features, keys, bin_size, "left")
    size = F.coalesce(F.least("end", "r_end") - F.greatest("start", "r_start"), F.lit(0))
    return pairs.withColumn("overlap", size)


def reciprocal(candidates: DataFrame, genes: Sequence[str], relaxed: bool = False) -> DataFrame:
    """Candidates whose best-scoring features all (relaxed: partly) belong to ``genes``;
    ones without any feature stay."""
    best = top_with_ties(candidates, "candidate", "bitscore", 1).groupBy("candidate").agg(F.collect_set("feature").alias("features"))
    wanted = F.array(*[F.lit(g) for g in genes])
    inside = F.arrays_overlap("features", wanted) if relaxed else F.size(F.array_except("features", wanted)) == 0
    return best.where((F.size("features") == 0) | inside).select("candidate")


def btop_expanded(btop: Column, query_start: Column, query_end: Column, query_len: Column) -> Column:
    """One letter an alignment column: . match, m mismatch, i query base without partner,
    d subject base without partner; blanks for query ends left out."""
    units = F.regexp_extract_all(btop, F.lit(r"(\d+|[A-Za-z-]{2})"), 1)
    one = lambda u: (
        F.when(u.rlike(r"^\d+$"), F.repeat(F.lit("."), F.coalesce(u.try_cast("int"), F.lit(0))))
        .when(u.startswith("-"), "d").when(u.endswith("-"), "i").otherwise("m")
    )
    body = F.array_join(F.transform(units, one), "")
    return F.concat(F.repeat(F.lit(" "), query_start), body, F.repeat(F.lit(" "), query_len - query_end))


def btop_positions(expanded: Column, from_end: bool = False) -> Column:
    """Array with an element a query position: its own letter and the deletions before it
    (trailing ones go to one more element), or, counted ``from_end``, those after it."""
    if from_end:
        return F.regexp_extract_all(expanded, F.lit(r"([.mi ]d*)"), 1)
    return F.regexp_extract_all(F.concat(expanded, F.lit("$")), F.lit(r"(d*[.mi $])"), 1)


def counted(expanded: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(expanded, f"[^{letters}]", ""))


def off_target_total(mismatches: Column, gaps: Column, aligned: Column, length: int, max_mismatch: int, max_gap: int) -> Column:
    """Whole-hit test: fewer mismatches and gaps than the limits (at least 1 each), and
    bases left out fit the slack that remains."""
    mm, gp = max(1, max_mismatch) - 1, max(1, max_gap) - 1
    return (mismatches <= mm) & (gaps <= gp) & ((mm - mismatches) + (gp - gaps) >= length - aligned)


def outside_masks(hits: DataFrame, masks: DataFrame, bin_size: int = 1000) -> DataFrame:
    """Hits that no mask of their molecule wholly contains."""
    m = masks.select("molecule", F.col("start").alias("r_start"), F.col("end").alias("r_end")).distinct()
    inside = range_join(hits, m, ["molecule"], bin_size).where("start >= r_start and end <= r_end").select("molecule", "start", "end").distinct()
    return hits.join(inside, ["molecule", "start", "end"], "left_anti")


def _coded(df: DataFrame, c: str, to: str, length: int) -> DataFrame:
    """(to0, to1..., to_text): sequences ``c`` of ``length`` letters, ``CODE`` letters in a long of
    three bits each; the text itself only where a letter has no code of its own.  Sequences of
    another length are left out."""
    at = range(0, length, CODE)
    digits = F.translate(F.regexp_replace(c, f"[^{LETTERS}]", "7"), LETTERS, "0123456")
    longs = [F.conv(F.substr(digits, F.lit(i + 1), F.lit(min(CODE, length - i))), 8, 10).cast("long").alias(f"{to}{k}") for k, i in enumerate(at)]
    return df.where(F.length(c) == length).select(*longs, F.when(F.col(c).rlike(f"[^{LETTERS}]"), F.col(c)).alias(f"{to}_text")).distinct()


def _pieces(codes: np.ndarray, length: int, skip: range, n: int) -> list[np.ndarray]:
    """Letters of ``codes`` (longs a row, see ``_coded``) outside ``skip`` in ``n`` runs, each run as
    one number of two bits a letter, eight letters at most; letters may share their two bits."""
    rest = [p for p in range(length) if p not in skip]
    out = []
    for i in range(n):
        piece = np.zeros(len(codes), np.uint16)
        for k, p in enumerate(rest[len(rest) * i // n : len(rest) * (i + 1) // n][:8]):
            piece |= _digit(codes, length, p, 3).astype(np.uint16) << np.uint16(2 * k)
        out.append(piece)
    return out


def _digit(codes: np.ndarray, length: int, p: int, bits: int = 7) -> np.ndarray:
    word = p // CODE
    return (codes[:, word] >> np.int64(3 * (min(CODE, length - word * CODE) - 1 - p % CODE))) & np.int64(bits)


def _texts(codes: np.ndarray, length: int, other: pa.Array) -> pa.Array:
    data = np.empty((len(codes), length), np.uint8)
    known = np.frombuffer(f"{LETTERS}?".encode(), np.uint8)
    for p in range(length):
        data[:, p] = known[_digit(codes, length, p)]
    plain = pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int32) * np.int32(length)), pa.py_buffer(data))
    return pc.coalesce(other, plain) if other.null_count < len(other) else plain


def _near(g: np.ndarray, w: np.ndarray, length: int, most: int, agree: int, part: int, cuts: list[int], bits: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``g`` and of ``w`` (longs a row) with ``most`` differing letters at most, and their
    number: pairs whose first equal part is ``part``, whose first letters are the same in all.
    Of the letters outside that part, in most + agree + 1 pieces, at least agree + 1 are equal;
    pairs meet by each such choice, and count for the first."""
    agree += 1
    lo, hi = cuts[part], cuts[part + 1]
    own = [_pieces(x, length, range(0, lo + SEED), 1)[0] if hi - lo > SEED else None for x in (g, w)]
    own_bits = 2 * min(hi - lo - SEED, 8) if own[0] is not None else 0
    if own_bits:
        own = [x & np.uint16((1 << own_bits) - 1) for x in own]
    n = most + agree
    pieces = [_pieces(x, length, range(lo, hi), n) for x in (g, w)]
    rest = length - (hi - lo)
    sizes = [2 * min(rest * (i + 1) // n - rest * i // n, 8) for i in range(n)]
    short = min(length, 32)
    two = [sum((_digit(x, length, p, 3).astype(np.uint64) << np.uint64(2 * p) for p in range(short)), np.zeros(len(x), np.uint64)) for x in (g, w)]
    low = np.uint64(int("01" * short, 2))
    ones = [np.int64(sum(1 << 3 * p for p in range(min(CODE, length - i)))) for i in range(0, length, CODE)]
    for choice in combinations(range(n), agree):
        keys, used = [np.zeros(len(x), np.uint16) for x in (g, w)], 0
        for values, size in ((own, own_bits), *(((pieces[0][i], pieces[1][i]), sizes[i]) for i in choice)):
            size = min(size, 16 - used)
            if size > 0:
                keys = [k | ((v & np.uint16((1 << size) - 1)) << np.uint16(used)) for k, v in zip(keys, values, strict=True)]
                used += size
        order, count = np.argsort(keys[1], kind="stable").astype(np.int32), np.bincount(keys[1], minlength=1 << 16)
        begin = np.cumsum(count) - count
        times = count[keys[0]]
        ends = np.cumsum(times)
        at = 0
        while at < len(g):  # some rows of g at a time, so that their pairs are few
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MET, "right")))
            k, total = times[at:to], int(ends[to - 1] - (ends[at - 1] if at else 0))
            if total:
                a = np.repeat(np.arange(at, to, dtype=np.int32), k)
                b = order[np.arange(total) + np.repeat(begin[keys[0][at:to]] - (np.cumsum(k) - k), k)]
                x = np.repeat(two[0][at:to], k) ^ two[1][b]
                good = np.flatnonzero(np.bitwise_count((x | (x >> np.uint64(1))) & low) <= most)
                a, b = a[good], b[good]
                other = [g[a, i] ^ w[b, i] for i in range(g.shape[1])]
                unlike = sum(np.bitwise_count((x | (x >> np.int64(1)) | (x >> np.int64(2))) & m).astype(np.int32) for x, m in zip(other, ones, strict=True))
                same = lambda i: np.logical_and.reduce([(x & np.int64(m)) == 0 for x, m in zip(other, bits[i], strict=True)])  # noqa: E731, B023
                ok = (unlike <= most) & same(part)
                for i in range(part):
                    ok &= ~same(i)
                for i in range(choice[-1] + 1 if choice else 0):
                    ok &= (pieces[0][i][a] == pieces[1][i][b]) == (i in choice)
                yield a[ok], b[ok], unlike[ok]
            at = to


def hamming_hits(guides: DataFrame, windows: DataFrame, length: int, most: int, agree: int = 1) -> DataFrame:
    """(grna, w, mismatches): windows within ``most`` mismatches of a guide, all of them:
    of most + 1 equal parts at least one is the same, so both are dealt by the first letters of
    each part, a row for each, and meet within a group by agree + 1 of most + agree + 1 pieces of
    the rest; a pair is kept for its first part and choice only.  More pieces make longer seeds,
    so fewer pairs meet by chance, and none of the choices is written to disk.
    Letters are compared as bits of longs; letters other than ``LETTERS`` share a code, and
    pairs that both have some are compared as texts."""
    parts = most + 1
    cuts = [length * i // parts for i in range(parts + 1)]
    words = [(i, min(CODE, length - i)) for i in range(0, length, CODE)]
    bits = lambda lo, hi, word: sum(7 << 3 * (word[0] + word[1] - 1 - p) for p in range(max(lo, word[0]), min(hi, word[0] + word[1])))
    masks = [[bits(cuts[i], cuts[i + 1], word) for word in words] for i in range(parts)]
    firsts = [[bits(cuts[i], min(cuts[i + 1], cuts[i] + SEED), word) for word in words] for i in range(parts)]
    keys = ["part", *[f"seed{k}" for k in range(len(words))]]
    coded = stored(_coded(guides, "grna", "g", length), "near"), stored(_coded(windows, "w", "w", length), "near")
    rows = parts * sum(df.count() for df in coded)
    tasks = max(int(guides.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(parts * 4**SEED, rows // SEEDED + 1))

    def seeds(df: DataFrame, to: str) -> DataFrame:
        pieces = [F.struct(F.lit(i).cast("byte").alias("part"), *[F.col(f"{to}{k}").bitwiseAND(F.lit(m)).alias(f"seed{k}") for k, m in enumerate(ms)]) for i, ms in enumerate(firsts)]
        dealt = merged_in_joins(df.select(*df.columns, F.explode(F.array(*pieces)).alias("x")).select("x.*", *df.columns))
        return dealt.repartition(tasks, *keys).groupBy(*keys)

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            g, w = (np.column_stack([t[f"{to}{k}"].to_numpy() for k in range(len(words))]) for t, to in ((left, "g"), (right, "w")))
            texts = left["g_text"].combine_chunks(), right["w_text"].combine_chunks()
            for a, b, unlike in _near(g, w, length, most, agree, left["part"][0].as_py(), cuts, masks):
                if len(a):
                    some = [t.take(pa.array(i)) for t, i in zip(texts, (a, b), strict=True)]
                    for i in np.flatnonzero(~(pc.is_null(some[0]).to_numpy(zero_copy_only=False) | pc.is_null(some[1]).to_numpy(zero_copy_only=False))).tolist():
                        unlike[i] = sum(x != y for x, y in zip(some[0][i].as_py(), some[1][i].as_py(), strict=True))
                    near = pa.table([_texts(g[a], length, some[0]), _texts(w[b], length, some[1]), pa.array(unlike, pa.int32())], names=["grna", "w", "mismatches"])
                    found.append(near.filter(pa.array(unlike <= most)))
        return pa.concat_tables(found) if found else pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.int32())], names=["grna", "w", "mismatches"])

    return seeds(coded[0], "g").cogroup(seeds(coded[1], "w")).applyInArrow(met, "grna string, w string, mismatches int")


def near_pam(seq: Column, start: Column, end: Column, strand: Column, q_start: Column, q_end: Column, length: int, gaps: Column, pam: Pam, max_gap: int) -> Column:
    """Whether a hit (+ coordinates on ``seq``) has the motif on either side within the gap
    allowance that is left and the guide's bases that did not align."""
    slack = F.lit(max(1, max_gap) - 1) - gaps
    left, right = pam.widths

    def beside(before: bool) -> Column:
        width = (F.lit(left) + slack + q_start) if before else (F.lit(right) + slack + length - q_end)
        width = F.greatest(width, F.lit(0))
        low = F.substr(seq, F.greatest(start - width, F.lit(0)) + 1, F.least(start, width))
        high = F.substr(seq, end + 1, width)
        plus, minus = (low, reverse_complement(high)) if before else (high, reverse_complement(low))
        return F.upper(F.when(strand == "-", minus).otherwise(plus))

    found = F.lit(False)
    if pam.before:
        found = found | beside(True).rlike(pam.before)
    if pam.after:
        found = found | beside(False).rlike(pam.after)
    return found


def masked_regions(masks: DataFrame, subjects: DataFrame, perfect: DataFrame | None = None) -> DataFrame:
    """(source, molecule, start, end, masked): where a sequence to be masked (seq_id, seq)
    stands whole and unchanged in ``subjects`` (source, molecule, seq), on either strand.

    Sequences meet windows by some of their bases, each by as many as its length allows (see
    ``SEEDS``), and are compared whole: a short one costs its own meetings only.  These bases
    begin at the first ``MARK``, so that only windows that begin with it are shuffled; at the
    first base where any sequence with as many bases has none before its last ones.
    ``perfect``: rows of a hit table (source, molecule, start, end, masked, q_start, q_end,
    q_len, mismatches, gaps) count besides where a hit covers its query without mismatch and gap.
    """
    m = masks.where(F.length("seq") > 0).select(F.col("seq_id").alias("masked"), F.upper("seq").alias("f")).distinct()
    forms = m.select("masked", F.explode(F.array_distinct(F.array("f", reverse_complement(F.col("f"))))).alias("f"))
    size = F.length("f")
    seed = F.when(size < SEEDS[0], size).otherwise(F.greatest(*[F.when(size >= k, k).otherwise(0) for k in (0, *SEEDS)]))
    marked = F.instr(F.substr("f", F.lit(1), size - F.col("k") + 1), MARK)
    # Stored: filters on a derived text would be pushed to the scan of a small file, one task's work.
    forms = stored(forms.withColumn("k", seed).withColumn("marked", marked), "masks")
    found = masks.sparkSession.createDataFrame([], "source string, molecule string, start int, end int, masked string")
    for r in forms.groupBy("k").agg(F.max(size).alias("longest"), F.min("marked").alias("least"), F.max("marked").alias("most")).orderBy("k").collect():  # a row for each length of seeds
        k, all_marked = r["k"], r["least"] > 0
        some = forms.where(F.col("k") == k).withColumn("before", F.col("marked") - 1 if all_marked else F.lit(0)).withColumn("w", F.substr("f", F.col("before") + 1, F.lit(k)))
        rows = windows(subjects.select("source", "molecule", F.upper("seq").alias("s")), ["source", "molecule"], k, r["most"] - 1 if all_marked else 0, r["longest"])
        at, start = F.col("at") - F.col("lo"), F.col("at") - F.col("before")
        if all_marked:
            rows = rows.where(letters(F.col("part"), at, F.lit(1)) == MARK)
        met = rows.withColumn("w", letters(F.col("part"), at, F.lit(k))).join(some, "w").where((start >= 0) & (letters(F.col("part"), at - F.col("before"), size) == F.col("f")))
        found = found.unionByName(met.select("source", "molecule", start.alias("start"), (start + size).alias("end"), "masked"))
    found = found.distinct()
    if perfect is not None:
        whole = perfect.where("q_start = 0 and q_end = q_len and mismatches = 0 and gaps = 0").select("source", "molecule", "start", "end", "masked")
        found = found.unionByName(whole).distinct()
    return found


def problematic_hits(hits: DataFrame, masks: DataFrame, aligned: Column, motif: Column | None = None) -> DataFrame:
    """Hits (molecule, start, end...) outside all masks of their molecule that align too
    well (``aligned``) and, unless guides bind without it, lie near the motif."""
    risky = hits.where(aligned if motif is None else aligned & motif)
    return outside_masks(risky, masks)


def background_checked(guides: DataFrame, problematic: DataFrame) -> DataFrame:
    """``guides`` (grna) with the check ``background``: it fails with any problematic hit in
    any file, whatever the case of the sequence."""
    bad = problematic.select(F.upper("grna").alias("bad__")).distinct().withColumn("x__", F.lit(False))
    return guides.join(bad, F.upper("grna") == F.col("bad__"), "left").withColumn("background", F.coalesce("x__", F.lit(True))).drop("bad__", "x__")


def in_domains(subject: Column, wanted: Sequence[str]) -> Column:
    return F.substring_index(subject, "|", -1).isin(*wanted) | F.substring_index(subject, ":", -1).isin(*wanted)


def collapsed_queries(df: DataFrame, seq: str, key: str) -> DataFrame:
    """(rep, key, seq): one representative (smallest id) of each sequence, and whom it stands for."""
    rep = df.groupBy(seq).agg(F.min(key).alias("rep"))
    return df.join(rep, seq).select("rep", key, seq)
