"""Guides against a background within a number of edits: mismatches, insertions, deletions.

Of d + 3 parts of a guide three at least stand unchanged wherever the guide stands with d edits,
each shifted against the one before by no more bases than parts between them are left out.
Guides are dealt by the first of the three, the background's windows by their first letters;
in a group the other two meet by equality at each shift.  Each meeting gives a short stretch
of the background, on which all edit distances are computed at once for a batch of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.homology import COMPLEMENT, btop_of
from strandline.operators.scratch import stored
from strandline.operators.sequences import BASES, COMPLEMENTS, letters, windows

#: Pairs that are looked at together, and candidates whose distances are computed together.
PAIRS, BATCH = 65_536, 4_096
#: Parts that meet by equality, letters of each that do, letters of a text that ``PART`` letters
#: with two edits reach, and guides a task.
KEPT, PART, REACH, GUIDES = 3, 4, 6, 20_000
#: A distance counts this much in a cell (its square, for long texts); what is below tells the start.
STEP = 64


def _distances(guides: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each end in ``texts`` the least edits of the row's guide against a
    stretch that ends there, and its start, the latest of the best."""
    n, width = texts.shape
    kind, cost = (np.int16, STEP) if max(width, guides.shape[1]) < STEP else (np.int32, STEP * STEP)
    slope = cost * np.arange(width + 1, dtype=kind)
    row = np.broadcast_to(-np.arange(width + 1, dtype=kind), (n, width + 1)).copy()
    for i in range(guides.shape[1]):
        step = row + kind(cost)  # a guide base alone
        step[:, 1:] = np.minimum(step[:, 1:], row[:, :-1] + (texts != guides[:, i : i + 1]) * kind(cost))
        row = np.minimum.accumulate(step - slope, 1) + slope  # background bases alone
    edits = (row + kind(cost - 1)) // kind(cost)
    return edits, edits * kind(cost) - row


def _way(guide: str, text: str) -> str:
    """Steps of a best alignment of both whole: M, I (guide base alone), D (text base alone)."""
    table = [list(range(len(text) + 1))]
    for i, a in enumerate(guide, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(table[-1][j - 1] + (a != b), table[-1][j] + 1, row[-1] + 1))
        table.append(row)
    i, j, way = len(guide), len(text), []
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (guide[i - 1] != text[j - 1]):
            way.append("M")
            i, j = i - 1, j - 1
        elif i and table[i][j] == table[i - 1][j] + 1:
            way.append("I")
            i -= 1
        else:
            way.append("D")
            j -= 1
    return "".join(reversed(way))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Strings of ``width`` letters as rows of bytes."""
    data = "".join(column.to_pylist()).encode("latin-1", "replace")
    return np.frombuffer(data, np.uint8).reshape(len(column), width)


def _shapes(parts: int, most: int) -> list[tuple[tuple[int, ...], list[tuple[int, ...]]]]:
    """The choices of ``parts`` - ``most`` unchanged parts, each with the shifts of the later ones
    against the first.  Edits are laid to the part in which they are or which ends before them;
    where a part has several, parts beside it count as changed too, so that a run of changed
    parts has no more edits than parts, and no greater shift."""
    out = []
    for gone in combinations(range(parts), most):
        kept = tuple(i for i in range(parts) if i not in gone)
        steps = [range(a - b + 1, b - a) for a, b in zip(kept, kept[1:], strict=False)]
        out.append((kept, [tuple(np.cumsum(x).tolist()) for x in product(*steps)]))
    return out


@lru_cache(maxsize=1)
def _edits() -> np.ndarray:
    """For ``PART`` letters (rows) and the next ``REACH`` of a text (columns), both as codes of two
    bits a letter, the least edits of the letters against any first part of the text."""
    g, t = np.arange(4**PART)[:, None], np.arange(4**REACH)[None, :]
    row = [np.full((4**PART, 4**REACH), j, np.uint8) for j in range(REACH + 1)]
    for i in range(PART):
        new = [row[0] + np.uint8(1)]
        for j in range(REACH):
            unlike = (((g >> 2 * i) & 3) != ((t >> 2 * j) & 3)).astype(np.uint8)
            new.append(np.minimum(np.minimum(row[j] + unlike, row[j + 1] + np.uint8(1)), new[j] + np.uint8(1)))
        row = new
    return np.minimum.reduce(row).ravel()


def _code(m: np.ndarray, columns: range) -> np.ndarray:
    """Letters of some columns as one number a row, two bits each, the first the lowest."""
    out = np.zeros(len(m), np.uint16)
    for k, c in enumerate(columns):
        out |= ((m[:, c] >> 1) & 3).astype(np.uint16) << np.uint16(2 * k)
    return out


def _meetings(forms: np.ndarray, texts: np.ndarray, first: int, at: int, cuts: list[int], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``forms`` and of ``texts`` that may be near, all of them, in batches: part ``first``
    of the forms stands in the texts from column ``at``.  Letters count by two bits, which may be
    the same for letters other than A, C, G and T.  Of a run of changed parts the letters beside
    an unchanged one are looked up: they have no more edits than the run has parts."""
    few = [min(b - a, PART) for a, b in zip(cuts, cuts[1:], strict=False)]
    known: dict[tuple, np.ndarray] = {}

    def code(m: np.ndarray, columns: range) -> np.ndarray:
        key = (m is forms, columns.start, columns.stop, columns.step)
        if key not in known:
            known[key] = _code(m, columns)
        return known[key]

    waiting, held = [], 0
    for kept, shifts in _shapes(len(few), most):
        if kept[0] != first:
            continue
        want = np.zeros(len(forms), np.uint16)
        for i in kept[1:]:
            want = (want << np.uint16(2 * PART)) | code(forms, range(cuts[i], cuts[i] + few[i]))
        for by in shifts:
            # Where the forms' first column would be for a part of them to stand where it does.
            base = dict(zip(kept, [at - cuts[first] + x for x in (0, *by)], strict=True))
            have = np.zeros(len(texts), np.uint16)
            for i in kept[1:]:
                have = (have << np.uint16(2 * PART)) | code(texts, range(base[i] + cuts[i], base[i] + cuts[i] + few[i]))
            tests = []
            for i in kept:
                longer = range(cuts[i] + PART, cuts[i + 1])
                if longer:
                    tests.append([(longer, range(base[i] + longer.start, base[i] + longer.stop), None)])
            for lo, hi in zip((-1, *kept), (*kept, len(few)), strict=True):
                run = hi - lo - 1
                if 0 < run < 3:
                    l, r = cuts[lo + 1], cuts[hi]
                    after = (range(l, l + PART), range(base[lo] + l, base[lo] + l + REACH), run) if lo >= 0 and r - l >= PART else None
                    before = (range(r - 1, r - 1 - PART, -1), range(base[hi] + r - 1, base[hi] + r - 1 - REACH, -1), run) if hi < len(few) and r - l >= PART else None
                    apart = after and before and r - l >= 2 * PART
                    tests += [[after, before]] if apart else [[x] for x in (after, before) if x]
            order, sizes = np.argsort(have, kind="stable"), np.bincount(have, minlength=1 << 2 * PART * (KEPT - 1))
            begin = np.cumsum(sizes) - sizes
            rows = np.flatnonzero(sizes[want])
            n = sizes[want[rows]]
            ends = np.cumsum(n)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                k = np.arange(lo, min(lo + PAIRS, int(ends[-1])))
                r = np.searchsorted(ends, k, "right")
                a, b = rows[r], order[begin[want[rows[r]]] + k - (ends[r] - n[r])]
                for some in tests:
                    total = 0
                    for mine, its, run in some:
                        x, y = code(forms, mine)[a], code(texts, its)[b]
                        total = total + (x != y if run is None else _edits()[(x.astype(np.int32) << 2 * REACH) + y])
                    good = total <= (some[0][2] or 0)
                    a, b = a[good], b[good]
                waiting.append((a, b))
                held += len(a)
                if held >= BATCH:
                    yield tuple(np.concatenate(x) for x in zip(*waiting, strict=True))
                    waiting, held = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*waiting, strict=True))


def _hits(guides: DataFrame, upper: DataFrame, m: int, most: int, tasks: int, kind: str) -> DataFrame:
    """All ends near which guides (grna) of ``m`` letters stand in ``upper`` (molecule, s), some of
    them several times: a row for each, with the stretch (``kind`` names the columns)."""
    parts = most + min(KEPT, m - most)
    cuts = [m * i // parts for i in range(parts + 1)]
    sizes = [min(b - a, PART) for a, b in zip(cuts, cuts[1:], strict=False)]
    turned = np.arange(256, dtype=np.uint8)
    turned[np.frombuffer(BASES.encode(), np.uint8)] = np.frombuffer(COMPLEMENTS.encode(), np.uint8)
    side = m + most
    form = F.when(F.col("strand") == "-", F.reverse(F.translate("grna", BASES, COMPLEMENTS))).otherwise(F.col("grna"))
    firsts = F.array(*[F.struct(F.lit(i).alias("first"), F.substr("form", F.lit(cuts[i] + 1), F.lit(sizes[i])).alias("seed")) for i in range(most + 1)])
    seeds = guides.select("grna", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand")).withColumn("form", form).select("grna", "strand", F.explode(firsts).alias("x")).select("grna", "strand", "x.first", "x.seed")
    places = None
    for size in sorted(set(sizes[: most + 1])):
        w = windows(upper, ["molecule"], size, side, side)
        at = F.col("at") - F.col("lo")
        # The stretch around a window, with blanks where the molecule ends.
        before = letters(F.col("part"), F.greatest(at - side, F.lit(0)), F.least(at, F.lit(side)))
        stretch = F.rpad(F.concat(F.lpad(before, side, " "), letters(F.col("part"), at, F.lit(size + side))), 2 * side + size, " ")
        w = w.select(letters(F.col("part"), at, F.lit(size)).alias("seed"), "molecule", F.col("at").alias("pos"), "n", F.rpad(stretch, 2 * side + PART, " ").alias("stretch"))
        places = w if places is None else places.unionByName(w)

    def measured(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        grnas, texts = _matrix(left["grna"], m), _matrix(right["stretch"], 2 * side + PART)
        back, first = np.array([x == "-" for x in left["strand"].to_pylist()], bool), left["first"].to_numpy()
        pos, n = right["pos"].to_numpy(), right["n"].to_numpy()
        for i in np.unique(first).tolist() if right.num_rows else []:
            rows = np.flatnonzero(first == i)
            forms = np.where(back[rows, None], turned[grnas[rows]][:, ::-1], grnas[rows])
            lo = side - cuts[i] - most
            for a, b in _meetings(forms, texts, i, side, cuts, most):
                near = texts[b, lo : lo + m + 2 * most]
                edits, start = _distances(forms[a], near)
                row, end = np.nonzero(edits <= most)
                s, e = (pos[b[row]] - cuts[i] - most + x for x in (start[row, end], end))
                ok = (s >= 0) & (e <= n[b[row]]) & (e > s)
                row, s, e, end = row[ok], s[ok], e[ok], end[ok]
                if len(row):
                    cut = [near[r, y - z : y].tobytes().decode("latin-1") for r, y, z in zip(row.tolist(), end.tolist(), (e - s).tolist(), strict=True)]
                    edits = pa.array(edits[row, end], pa.int32())
                    found.append(pa.table([*(left[c].take(pa.array(rows[a[row]])) for c in ("grna", "strand")), right["molecule"].take(pa.array(b[row])), pa.array(s, pa.int32()), pa.array(e, pa.int32()), edits, pa.array(cut, pa.string())], names=names))
        return pa.concat_tables(found) if found else empty

    names = [x.split()[0] for x in kind.split(", ")]
    empty = pa.table([pa.array([], pa.int32() if x.endswith(" int") else pa.string()) for x in kind.split(", ")], names=names)
    return seeds.repartition(tasks, "seed").groupBy("seed").cogroup(places.repartition(tasks, "seed").groupBy("seed")).applyInArrow(measured, kind)


def edit_hits(guides: DataFrame, subjects: DataFrame, most: int, every_end: bool = False) -> DataFrame:
    """(grna, molecule, strand, start, end, edits, mismatches, gaps, btop): where guides (grna)
    stand in ``subjects`` (molecule, seq) with ``most`` edits or fewer, on both strands.

    A hit is an end on the + strand, with the least edits of a stretch that ends there and, of
    the best stretches, the shortest.  Of hits of a guide and strand whose ends lie within
    ``most`` bases the one with the fewest edits stays, the first of equals, unless
    ``every_end``.  Coordinates are those of the + strand; BTOP goes along the guide, which is
    aligned whole.  Guides may differ in length; letters other than equal ones mismatch.
    Guides too short to be cut into ``most`` + 1 parts raise ValueError.
    """
    g = stored(guides.select(F.upper("grna").alias("grna")).where(F.length("grna") > 0).distinct(), "guides")
    upper = subjects.select("molecule", F.upper("seq").alias("s"))
    kind = "grna string, strand string, molecule string, start int, end int, edits int, text string"
    hits = g.sparkSession.createDataFrame([], kind)
    usual = int(g.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for m, count in sorted(map(tuple, g.groupBy(F.length("grna")).count().collect())):  # a guide's lengths are few
        if m <= most:
            raise ValueError(f"a guide of {m} bases cannot be searched with {most} edits")
        hits = hits.unionByName(_hits(g.where(F.length("grna") == m), upper, m, most, max(usual, min(4**PART, count // GUIDES + 1)), kind))
    hits = hits.groupBy("grna", "strand", "molecule", "end").agg(F.min(F.struct("edits", (-F.col("start")).alias("s"), "text")).alias("b"))
    hits = hits.select("grna", "strand", "molecule", "end", "b.edits", (-F.col("b.s")).alias("start"), "b.text")
    if not every_end:
        near = Window.partitionBy("grna", "strand", "molecule").orderBy("end").rangeBetween(-most, most)
        hits = hits.withColumn("least", F.min(F.struct("edits", "end")).over(near)).where("least.edits = edits and least.end = end").drop("least")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mismatches, gaps, btops = [], [], []
            for guide, strand, text in zip(*(b.column(c).to_pylist() for c in ("grna", "strand", "text")), strict=True):
                text = text.translate(COMPLEMENT)[::-1] if strand == "-" else text
                btop, _, other, _, gap = btop_of(guide, text, _way(guide, text))
                mismatches.append(other)
                gaps.append(gap)
                btops.append(btop)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("grna", "molecule", "strand", "start", "end", "edits")), pa.array(mismatches, pa.int32()), pa.array(gaps, pa.int32()), pa.array(btops, pa.string())],
                names=["grna", "molecule", "strand", "start", "end", "edits", "mismatches", "gaps", "btop"],
            )

    return hits.mapInArrow(aligned, "grna string, molecule string, strand string, start int, end int, edits int, mismatches int, gaps int, btop string")
