"""Multiple alignments: reference genes by progressive profiles, targets added to a profile.

The references of a set (a bounded number) are aligned in one task along a guide tree of
shared words.  Targets, however many, are each aligned with the finished profile on their own,
in both directions; what they insert between its columns is put together afterwards.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.alignment import TURNED, column_ranges
from strandline.operators.homology import COMPLEMENT
from strandline.operators.joins import spread
from strandline.operators.scratch import stored

MATCH, MISMATCH, GAP, OPEN = 2.0, -1.0, 1.5, 4.0
#: Letters of a word by which sequences are compared for the guide tree.
WORD = 6
#: References of a set, cells of a table of two profiles, targets of a task's block.
MOST_REFERENCES, MOST_CELLS, BLOCK = 200, 400_000_000, 32
#: Columns, in all, of profiles that are aligned at once; sets or targets, and letters, that wait for it.
AT_ONCE, WAITING, LETTERS = 8_192, 64, 1_000_000
_CODE = np.full(256, 4, np.int64)  # A, C, G, T; anything else; a gap
for _i, _letters in enumerate((b"Aa", b"Cc", b"Gg", b"TtUu")):
    _CODE[list(_letters)] = _i
_CODE[ord("-")] = 5
_PAIRS = np.full((5, 5), MISMATCH)
np.fill_diagonal(_PAIRS, MATCH)
_PAIRS[4, :] = _PAIRS[:, 4] = 0


def _matrix(rows: Sequence[str]) -> np.ndarray:
    return np.array([np.frombuffer(r.encode("latin-1", "replace"), np.uint8) for r in rows])


def _counts(matrix: np.ndarray) -> np.ndarray:
    """Rows with each letter, by column: (columns, 6)."""
    codes = _CODE[matrix]
    return np.stack([(codes == c).sum(0) for c in range(6)], 1).astype(float)


def sum_of_pairs(rows: Sequence[str]) -> float:
    """Score of an alignment: all pairs of rows, column by column; a gap against a letter costs
    ``GAP``, two gaps nothing."""
    n = _counts(_matrix(rows))
    letters, gaps = n[:, :5], n[:, 5]
    both = (np.einsum("ca,ab,cb->c", letters, _PAIRS, letters) - letters @ np.diag(_PAIRS)) / 2
    return float((both - GAP * gaps * letters.sum(1)).sum())


def _way(trace: np.ndarray) -> str:
    """The steps that a table of choices leads to, from its last corner back to its first."""
    width, codes = trace.shape[1], trace.tobytes()
    i, j, steps, state = trace.shape[0] - 1, width - 1, [], 0
    while i or j:
        code = codes[i * width + j]
        kind = state or code & 3
        if j == 0:
            kind = 2
        elif i == 0:
            kind = 3
        if kind == 1:
            steps.append("M")
            i, j, state = i - 1, j - 1, 0
        elif kind == 2:
            steps.append("I")
            state = 2 if code & 4 else 0
            i -= 1
        else:
            steps.append("D")
            state = 3 if code & 8 else 0
            j -= 1
    return "".join(reversed(steps))


def paired(a: np.ndarray, b: np.ndarray) -> tuple[float, str]:
    """The best alignment of two profiles (counts by column) from end to end, as its score and
    its steps: M both, I a column of ``a`` alone, D one of ``b`` alone.  Opening a gap costs
    nothing at the ends; a column that is mostly gaps is cheap to leave alone."""
    return all_paired([(a, b)])[0]


def all_paired(pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, str]]:
    """``paired`` of each pair; pairs of about one size are worked through at once, row by row."""
    sizes = [(len(b), len(a)) for a, b in pairs]
    for m, n in sizes:
        if n * m > MOST_CELLS:
            raise ValueError(f"{n} and {m} columns are too long to be aligned at once")
    out: list = [None] * len(pairs)
    order, begin = sorted(range(len(pairs)), key=sizes.__getitem__), 0
    while begin < len(order):
        end, longest, cells = begin, 0, 0
        while end < len(order):
            m, n = sizes[order[end]]
            longest, cells, many = max(longest, n), cells + (n + 1) * (m + 1), end - begin + 1
            if many > 1 and (many * (m + 1) > AT_ONCE or many * (longest + 1) * (m + 1) > 2 * cells):
                break
            end += 1
        for k, found in zip(order[begin:end], _paired_at_once([pairs[k] for k in order[begin:end]]), strict=True):
            out[k] = found
        begin = end
    return out


def _paired_at_once(pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, str]]:
    """``paired`` of each pair, in tables of the largest pair's size: what lies beyond a smaller
    one's last row or column reaches no cell within."""
    many, n, m = len(pairs), max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    rows, columns = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    # The last of the five letters scores nothing with any.
    left, fb = np.zeros((n, 4, many, 1)), np.zeros((4, many, m))
    full_a, full_b = np.zeros((n, many, 1)), np.zeros((many, m))
    for k, (a, b) in enumerate(pairs):
        fa, f = a[:, :5] / a.sum(1, keepdims=True), b[:, :5] / b.sum(1, keepdims=True)
        left[: len(a), :, k, 0], fb[:, k, : len(b)] = (fa @ _PAIRS)[:, :4], f[:, :4].T
        full_a[: len(a), k, 0], full_b[k, : len(b)] = fa.sum(1), f.sum(1)
    along = np.concatenate([np.zeros((many, 1)), GAP * np.cumsum(full_b, 1)], 1)
    opened = np.concatenate([OPEN * full_b, np.zeros((many, 1))], 1)
    each = np.arange(many)
    opened[each, columns] = 0
    inner = np.ones((many, m + 1))
    inner[:, 0] = inner[each, columns] = 0
    low = -1e18
    h, v = -along.copy(), np.full((many, m + 1), low)
    d, e, goes = np.full((many, m + 1), low), np.full((many, m + 1), low), np.zeros((many, m + 1), bool)
    trace = np.zeros((many, n + 1, m + 1), np.uint8)
    trace[:, 0] = 3 | 8
    scores = np.zeros(many)
    for i in range(1, n + 1):
        gap, x = GAP * full_a[i - 1], left[i - 1]
        up = h - gap - inner * (OPEN * full_a[i - 1])
        on = v - gap
        v = np.maximum(up, on)
        d[:, 1:] = h[:, :-1] + (fb[0] * x[0] + fb[1] * x[1] + fb[2] * x[2] + fb[3] * x[3])
        into = np.maximum(d, v)
        last = rows == i
        start = into + along - (np.where(last[:, None], 0, opened) if last.any() else opened)
        far = np.maximum.accumulate(start, 1)
        e[:, 1:] = far[:, :-1] - along[:, 1:]
        goes[:, 2:] = far[:, :-2] >= start[:, 1:-1]
        h = np.maximum(into, e)
        along_both = d >= h
        best = 3 - (along_both.view(np.uint8) << 1 | (v >= h).view(np.uint8) & ~along_both.view(np.uint8))
        trace[:, i] = best | (on >= up).view(np.uint8) << 2 | goes.view(np.uint8) << 3
        if last.any():
            scores[last] = h[last, columns[last]]
    return [(float(scores[k]), _way(trace[k, : len(a) + 1, : len(b) + 1])) for k, (a, b) in enumerate(pairs)]


#: Work that asks for alignments of two profiles and goes on with each one's score and steps.
Work = Generator[tuple[np.ndarray, np.ndarray], tuple[float, str], list[str]]


def _together(works: Sequence[Work]) -> list[list[str]]:
    """The results of works; the alignments that they ask for next are made at once."""
    out, asked = [[]] * len(works), {}

    def on(k: int, answer: tuple[float, str] | None) -> None:
        try:
            asked[k] = works[k].send(answer)
        except StopIteration as end:
            out[k] = end.value

    for k in range(len(works)):
        on(k, None)
    while asked:
        now = dict(asked)
        asked.clear()
        for k, answer in zip(now, all_paired(list(now.values())), strict=True):
            on(k, answer)
    return out


def _spread(matrix: np.ndarray, way: str, gap: str) -> np.ndarray:
    """The rows with a column of gaps at each step ``gap``."""
    keep = np.frombuffer(way.encode(), np.uint8) != ord(gap)
    out = np.full((len(matrix), len(way)), ord("-"), np.uint8)
    out[:, keep] = matrix
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> Generator:
    _, way = yield _counts(a), _counts(b)
    return np.concatenate([_spread(a, way, "D"), _spread(b, way, "I")])


def _distances(seqs: Sequence[str]) -> np.ndarray:
    """1 - shared words of two sequences over those of the shorter one."""
    words = [{s[i : i + WORD] for i in range(max(len(s) - WORD, 0) + 1)} for s in seqs]
    out = np.zeros((len(seqs), len(seqs)))
    for i, a in enumerate(words):
        for j in range(i):
            out[i, j] = out[j, i] = 1 - len(a & words[j]) / max(min(len(a), len(words[j])), 1)
    return out


def aligned_rows(seqs: Sequence[str]) -> list[str]:
    """``seqs`` (not empty) as rows of one length: the nearest groups are joined first, then
    each row is taken out and put back where that improves the sum of pairs."""
    return _together([_aligning(seqs)])[0]


def _aligning(seqs: Sequence[str]) -> Work:
    if len(seqs) == 1:
        return list(seqs)
    dist = _distances(seqs)
    np.fill_diagonal(dist, np.inf)
    groups = {i: (_matrix([s]), [i]) for i, s in enumerate(seqs)}
    while len(groups) > 1:
        i, j = divmod(int(dist.argmin()), len(seqs))
        (a, x), (b, y) = groups[i], groups.pop(j)
        groups[i] = ((yield from _joined(a, b)), x + y)
        mean = (dist[i] * len(x) + dist[j] * len(y)) / (len(x) + len(y))
        dist[i], dist[:, i] = mean, mean
        dist[j], dist[:, j] = np.inf, np.inf
        dist[i, i] = np.inf
    ((matrix, order),) = groups.values()
    score = sum_of_pairs([r.tobytes().decode("latin-1") for r in matrix]) if len(matrix) > 2 else 0.0
    for row in range(len(matrix)) if len(matrix) > 2 else ():
        rest = np.delete(matrix, row, 0)
        rest = rest[:, (rest != ord("-")).any(0)]
        bare = matrix[row][matrix[row] != ord("-")][None]
        new = yield from _joined(rest, bare)
        new = np.insert(new[:-1], row, new[-1], axis=0)
        better = sum_of_pairs([r.tobytes().decode("latin-1") for r in new])
        if better > score:
            matrix, score = new, better
    rows = {o: r.tobytes().decode("latin-1") for o, r in zip(order, matrix, strict=True)}
    return [rows[i] for i in range(len(seqs))]


def aligned_references(genes: DataFrame, coding: DataFrame) -> DataFrame:
    """(aln_id, seq_id, kind, aln): the genes (aln_id, seq_id, seq) of each set aligned, kind
    ``gene``, and a row for each coding sequence, kind ``cds``: the gene's bases within
    ``coding`` (aln_id, seq_id: the gene, cds_id, start, end, in the gene's bases), gaps elsewhere.

    A set lies in one task, which takes several sets together; of more than
    ``MOST_REFERENCES`` genes it raises ValueError, as do two that are too long for
    ``MOST_CELLS``.  Genes without bases have no row.  The genes' rows are stored.
    """
    kind = genes.schema["aln_id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[tuple[object, list[str], list[str]]] = []

        def aligned() -> pa.RecordBatch:
            found = _together([_aligning(seqs) for _, _, seqs in sets])
            rows = [(i, name, row) for (i, names, _), done in zip(sets, found, strict=True) for name, row in zip(names, done, strict=True)]
            sets.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], key), *(pa.array([r[c] for r in rows], pa.string()) for c in (1, 2))], ["aln_id", "seq_id", "aln"])

        key, letters = pa.null(), 0
        for batch in batches:
            key = batch.column(0).type
            for aln_id, seq_id, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not sets or sets[-1][0] != aln_id:
                    if len(sets) >= WAITING or letters > LETTERS:
                        yield aligned()
                        letters = 0
                    sets.append((aln_id, [], []))
                sets[-1][1].append(seq_id)
                sets[-1][2].append(seq)
                letters += len(seq)
                if len(sets[-1][2]) > MOST_REFERENCES:
                    raise ValueError(f"more than {MOST_REFERENCES} references of {aln_id} are too many to be aligned")
        if sets:
            yield aligned()

    bare = spread(genes.select("aln_id", "seq_id", "seq").where(F.length("seq") > 0), "aln_id").sortWithinPartitions("aln_id", "seq_id", "seq")
    done = stored(bare.mapInArrow(align, f"aln_id {kind}, seq_id string, aln string"), "references")
    places = coding.select("aln_id", F.concat_ws("\0", "seq_id", "cds_id").alias("seq_id"), "start", "end")
    named = done.join(coding.select("aln_id", "seq_id", "cds_id").distinct(), ["aln_id", "seq_id"]).select("aln_id", F.concat_ws("\0", "seq_id", "cds_id").alias("seq_id"), "aln")
    spans = column_ranges(named, places).groupBy("aln_id", "seq_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("r"))
    rows = named.join(spans, ["aln_id", "seq_id"])
    # Gaps up to each span, the span, and gaps to the end.
    pieces = F.transform("r", lambda r, i: F.concat(F.repeat(F.lit("-"), r["start"] - F.when(i > 0, F.get("r", i - 1)["end"]).otherwise(0)), F.substr("aln", r["start"] + 1, r["end"] - r["start"])))
    cds = rows.select("aln_id", F.element_at(F.split("seq_id", "\0"), 2).alias("seq_id"), F.lit("cds").alias("kind"), F.concat(F.array_join(pieces, ""), F.repeat(F.lit("-"), F.length("aln") - F.element_at("r", -1)["end"])).alias("aln"))
    return done.select("aln_id", "seq_id", F.lit("gene").alias("kind"), "aln").unionByName(cds)


def added_targets(alignment: DataFrame, targets: DataFrame) -> DataFrame:
    """(aln_id, seq_id, aln): the rows of ``alignment`` (aln_id, seq_id, kind, aln), its genes
    and coding rows, and the ``targets`` (aln_id, seq_id, seq) of the same sets, all of a set of
    one length.  A target is aligned with the genes' profile as it is and turned round; where
    the second scores higher its id begins with ``_R_``.  Targets keep the profile's columns;
    what several insert at one place stands together, from the left.  Targets of sets without
    genes, and those without bases, have no row; ids that are in the alignment are left out.
    """
    kind = alignment.schema["aln_id"].dataType.simpleString()
    alignment = stored(alignment, "references")  # read several times
    known = alignment.select("aln_id", "seq_id")
    new = targets.select("aln_id", "seq_id", F.upper("seq").alias("seq")).where(F.length("seq") > 0).join(known, ["aln_id", "seq_id"], "left_anti")
    new = stored(new, "targets")
    profiles = alignment.where("kind = 'gene'").groupBy("aln_id").agg(F.sort_array(F.collect_list("aln")).alias("rows"))
    many = new.groupBy("aln_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = new.join(many, "aln_id").select("aln_id", F.pmod(F.xxhash64("seq_id"), "blocks").cast("int").alias("block"), F.lit(None).cast("array<string>").alias("rows"), "seq_id", "seq")
    offered = profiles.join(many, "aln_id").select("aln_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rows", F.lit(None).cast("string").alias("seq_id"), F.lit(None).cast("string").alias("seq"))

    def added(aln_id, seq_id, seq, turned, forth, back):
        (score, way), (other, over) = forth, back
        if other > score:
            seq_id, seq, way = TURNED + seq_id, turned, over
        # The bases over the profile's columns, and those between them.
        row, places, inserted, at, col = [], [], [], 0, 0
        for step in way:
            if step == "I":
                row.append("-")
            elif step == "M":
                row.append(seq[at])
            elif places and places[-1] == col:
                inserted[-1] += seq[at]
            else:
                places.append(col)
                inserted.append(seq[at])
            at, col = at + (step != "I"), col + (step != "D")
        return aln_id, seq_id, "".join(row), places, inserted

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's profile comes first, then its targets."""
        waiting: list[tuple] = []

        def made() -> pa.RecordBatch:
            ways = all_paired([(counts, _counts(_matrix([s]))) for *_, seq, turned, counts in waiting for s in (seq, turned)])
            rows = [added(*w[:4], *ways[2 * k : 2 * k + 2]) for k, w in enumerate(waiting)]
            waiting.clear()
            types = (key, pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], ["aln_id", "seq_id", "aln", "places", "inserted"])

        key, block, counts, letters = pa.null(), None, None, 0
        for batch in batches:
            key = batch.column(0).type
            for aln_id, number, rows, seq_id, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows is not None:
                    block, counts = (aln_id, number), _counts(_matrix(rows))
                elif block == (aln_id, number):
                    waiting.append((aln_id, seq_id, seq, seq.translate(COMPLEMENT)[::-1], counts))
                    letters += len(seq) + len(counts)
                    if len(waiting) >= WAITING or letters > LETTERS:
                        yield made()
                        letters = 0
        if waiting:
            yield made()

    both = spread(offered.unionByName(dealt), "aln_id", "block").sortWithinPartitions("aln_id", "block", F.col("rows").isNull())
    placed = stored(both.mapInArrow(add, f"aln_id {kind}, seq_id string, aln string, places array<int>, inserted array<string>"), "placed")
    old = alignment.select("aln_id", "seq_id", "aln", F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("inserted"))
    rows = old.unionByName(placed)
    widths = placed.select("aln_id", F.explode(F.arrays_zip("places", "inserted")).alias("x")).groupBy("aln_id", F.col("x.places").alias("place")).agg(F.max(F.length("x.inserted")).alias("width"))
    gaps = widths.groupBy("aln_id").agg(F.array_sort(F.collect_list(F.struct("place", "width"))).alias("gaps"))
    rows = rows.join(gaps, "aln_id", "left")
    own = lambda p: F.coalesce(F.get("inserted", F.nullif(F.array_position("places", p), F.lit(0)) - 1), F.lit(""))
    before = lambda i: F.when(i > 0, F.get("gaps", i - 1)["place"]).otherwise(0)
    pieces = F.transform("gaps", lambda g, i: F.concat(F.substr("aln", before(i) + 1, g["place"] - before(i)), F.rpad(own(g["place"]), g["width"], "-")))
    wide = F.concat(F.array_join(pieces, ""), F.substr("aln", F.element_at("gaps", -1)["place"] + 1))
    return rows.select("aln_id", "seq_id", F.coalesce(wide, "aln").alias("aln"))
