"""Coverage of targets by guides and minimum covering sets."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.joins import merged_in_joins
from strandline.operators.prefix import global_prefix
from strandline.operators.scratch import stored

#: Guides, and their pairs with targets, that a round of the cover brings to the driver at most.
CANDIDATES, PAIRS = 4_096, 500_000


def coverage(hits: DataFrame) -> DataFrame:
    """(grna, n_targets, targets): distinct targets, sorted."""
    return hits.groupBy("grna").agg(F.array_sort(F.collect_set("target_id")).alias("targets")).select("grna", F.size("targets").alias("n_targets"), "targets")


def position_5prime() -> Column:
    """Distance of a hit to the 5' end of the sense strand."""
    return F.when(F.col("sense") == "-", F.col("target_len") - F.col("end")).otherwise(F.col("start"))


def relative_position(hits: DataFrame) -> DataFrame:
    """(grna, pos): mean distance of the guide's hits to the 5' end of the sense strand."""
    return hits.groupBy("grna").agg(F.avg(position_5prime()).alias("pos"))


def collapsed(hits: DataFrame) -> DataFrame:
    """(cg, grna, n_targets, targets): guides with the same targets share a group; groups
    are numbered from the largest coverage, with equal digits."""
    cover = coverage(hits)
    ordered = global_prefix(cover.select("targets").distinct(), [F.desc(F.size("targets")), F.col("targets")], [])
    numbered = ordered.select("targets", (F.col("row_before") + 1).alias("rank"))
    most = numbered.agg(F.length(F.max("rank").cast("string")).alias("digits"))
    digits = F.col("digits")
    named = numbered.crossJoin(F.broadcast(most)).select("targets", F.concat(F.lit("cg_"), F.lpad(F.col("rank").cast("string"), 12, "0").substr(F.lit(13) - digits, digits)).alias("cg"))
    return cover.join(named, "targets").select("cg", "grna", "n_targets", "targets")


def ends_of_groups(groups: DataFrame, positions: DataFrame) -> DataFrame:
    """(cg, most_5prime, least_5prime): the guides nearest to and farthest from the 5' end;
    ties go to the smaller name."""
    rows = groups.join(positions, "grna").groupBy("cg")
    return rows.agg(F.min_by("grna", F.struct("pos", "grna")).alias("most_5prime"), F.min_by("grna", F.struct(-F.col("pos"), "grna")).alias("least_5prime"))


def paired(hits: DataFrame) -> DataFrame:
    """(grna, target, s, n): sum and number of 5' positions of a guide's hits on a target."""
    return hits.groupBy("grna", F.col("target_id").alias("target")).agg(F.sum(position_5prime()).alias("s"), F.count(F.lit(1)).alias("n"))


def ranked_pairs(hits: DataFrame, ranks: DataFrame) -> DataFrame:
    """``paired`` with the guide's place by (rank, name) instead of positions, so that the mean
    over any of its targets is that place."""
    rank = ranks.groupBy("grna").agg(F.min("rank").alias("rank"))
    guides = hits.select("grna").distinct().join(rank, "grna", "left")
    order = global_prefix(guides, [F.asc_nulls_last("rank"), F.col("grna")], []).select("grna", F.col("row_before").alias("s"))
    return hits.select("grna", F.col("target_id").alias("target")).distinct().join(order, "grna").select("grna", "target", "s", F.lit(1).alias("n"))


def tie_keys(pairs: DataFrame, covered: DataFrame) -> DataFrame:
    """(grna, gain, pos, redundancy): targets of a guide not in ``covered`` (target), mean 5'
    position of its hits on those, and how many of its targets are covered."""
    rows = pairs.join(covered.select("target").distinct().withColumn("old", F.lit(True)), "target", "left")
    new = F.col("old").isNull()
    per = rows.groupBy("grna").agg(F.count_if(new).alias("gain"), F.sum(F.when(new, F.col("s"))).alias("s"), F.sum(F.when(new, F.col("n"))).alias("n"), F.count_if(~new).alias("redundancy"))
    return per.select("grna", "gain", (F.col("s") / F.col("n")).alias("pos"), "redundancy")


def sure_picks(sets: dict[str, dict], every: dict[str, tuple], whole_pos: bool, bound: tuple | None) -> tuple[list[str], set]:
    """Greedy picks among ``sets`` (grna: {open target: (s, n)}) and the targets that they cover:
    most open targets, then nearest to 5', then fewest covered ones, then by name.  ``every`` has
    for each guide the number of all of its targets, and its mean position on them.  Picks end at
    the first that comes after ``bound``: a guide not at hand may come before it.  A guide's key
    changes only with its number of open targets, and that only falls, so a waiting key whose
    number is still right is right altogether."""
    covered: set = set()

    def key(g: str) -> tuple:
        on = [v for t, v in sets[g].items() if t not in covered]
        pos = every[g][1] if whole_pos else sum(v[0] for v in on) / sum(v[1] for v in on) if on else 0.0
        return (-len(on), pos if on else 0.0, every[g][0] - len(on), g)

    chosen, heap = [], [key(g) for g in sets]
    heapq.heapify(heap)
    while heap:
        old = heapq.heappop(heap)
        if bound is not None and old > bound:
            break
        now = key(old[3])
        if now != old:
            heapq.heappush(heap, now)
        elif now[0]:
            chosen.append(old[3])
            covered.update(sets[old[3]])
    return chosen, covered


def guide_rows(pairs: DataFrame) -> DataFrame:
    """(grna, all, all_pos, targets, s, n): ``paired`` with a row for each guide."""
    per = pairs.groupBy("grna").agg(F.collect_list(F.struct("target", "s", "n")).alias("p"), F.count(F.lit(1)).alias("all"), (F.sum("s") / F.sum("n")).alias("all_pos"))
    return per.select("grna", "all", "all_pos", F.col("p.target").alias("targets"), F.col("p.s").alias("s"), F.col("p.n").alias("n"))


def _open(rows: DataFrame, covered: set, sums: bool) -> DataFrame:
    """Guide rows without their ``covered`` targets (a bounded number), and without guides that
    have no other; with ``sums`` not arrays but gain (their number) and the sums of s and n.
    Each row by itself: nothing is shuffled."""
    schema = rows.schema
    s_type = schema["s"].dataType.elementType.simpleString()
    gone = rows.sparkSession.sparkContext.broadcast(sorted(covered))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(3)
            flat = lists.flatten()
            known = pa.array(gone.value, flat.type) if known is None else known
            new = pc.invert(pc.is_in(flat, value_set=known)).to_numpy(zero_copy_only=False)
            first = (lists.offsets.to_numpy() - lists.offsets[0].as_py())[:-1]  # no list is empty
            gain = np.add.reduceat(new.astype(np.int64), first)
            some = pa.array(gain > 0)
            scalars = [b.column(i).filter(some) for i in range(3)]
            values = [b.column(i).flatten() for i in (4, 5)]
            if sums:
                totals = [np.add.reduceat(np.where(new, pc.fill_null(v, 0).to_numpy(zero_copy_only=False), 0), first) for v in values]
                yield pa.RecordBatch.from_arrays([*scalars, *[pa.array(x).filter(some) for x in (gain, *totals)]], names=["grna", "all", "all_pos", "gain", "s", "n"])
            else:
                ends = pa.array(np.concatenate([[0], np.cumsum(gain[gain > 0])]).astype(np.int32))
                arrays = [pa.ListArray.from_arrays(ends, x.filter(pa.array(new))) for x in (flat, *values)]
                yield pa.RecordBatch.from_arrays([*scalars, *arrays], names=b.schema.names)

    return rows.mapInArrow(kept, f"grna string, all long, all_pos double, gain long, s {s_type}, n long" if sums else schema)


def _without_targets(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Guide rows without the targets in ``gone`` (target), however many."""
    pairs = rows.select("grna", "all", "all_pos", F.explode(F.arrays_zip("targets", "s", "n")).alias("x")).select("grna", "all", "all_pos", F.col("x.targets").alias("target"), "x.s", "x.n")
    per = pairs.join(gone, "target", "left_anti").groupBy("grna", "all", "all_pos").agg(F.collect_list(F.struct("target", "s", "n")).alias("p"))
    return per.select("grna", "all", "all_pos", F.col("p.target").alias("targets"), F.col("p.s").alias("s"), F.col("p.n").alias("n"))


def _last_picks(rows: DataFrame, covered: set, whole_pos: bool) -> DataFrame:
    """(grna): what the greedy cover picks once no guide has more than one open target: of each
    open target's guides the first.  A pick then takes nothing from guides of other targets."""
    one = _open(rows, covered, sums=False)
    pos = F.col("all_pos") if whole_pos else F.element_at("s", 1) / F.element_at("n", 1)
    keys = one.select(F.element_at("targets", 1).alias("target"), F.struct(pos.alias("pos"), (F.col("all") - 1).alias("red"), "grna").alias("key"))
    return keys.groupBy("target").agg(F.min("key").alias("key")).select("key.grna")


def greedy_cover(rows: DataFrame, n_targets: int, whole_pos: bool = False) -> tuple[list[str], DataFrame | None]:
    """Guides in the order in which the greedy cover picks them, from ``guide_rows`` of at least
    one guide for each of ``n_targets`` targets, and a table (grna) of those that it picks last,
    where they have one open target each and are many.  Ties go to the guide nearest to 5' on its
    uncovered targets (``whole_pos``: on all), then to the least redundant, then by name.

    Each round counts the uncovered targets of all guides where their rows stand and brings only
    the first guides to the driver (at most ``CANDIDATES`` with ``PAIRS`` uncovered pairs).  Counts
    never grow, so picks that come before the last of these are those of the whole table.  Rows are
    written anew, shorter, only when half of what they hold is covered: what is written adds up to
    no more than about the table, however many rounds there are.
    """
    chosen, left, open_, covered = [], rows, n_targets, set()
    while True:
        gains = _open(left, covered, sums=True).select("grna", "gain", "all", "all_pos", (F.col("all_pos") if whole_pos else F.col("s") / F.col("n")).alias("pos"), (F.col("all") - F.col("gain")).alias("red"))
        top = gains.orderBy(F.desc("gain"), "pos", "red", "grna").limit(CANDIDATES).collect()
        if not top:
            return chosen, None
        if top[0]["gain"] == 1 and len(top) == CANDIDATES:
            return chosen, stored(_last_picks(left, covered, whole_pos), "cover")
        sums = list(accumulate(r["gain"] for r in top))
        first = top[: max(1, sum(n <= PAIRS for n in sums))]
        whole = len(first) == len(top) < CANDIDATES
        names = F.broadcast(rows.sparkSession.createDataFrame([(r["grna"],) for r in first], "grna string"))
        if first[0]["gain"] > PAIRS:  # its targets do not come to the driver
            gone = _open(left, covered, sums=False).join(names, "grna", "left_semi").select(F.explode("targets").alias("target"))
            left, covered, open_ = stored(_without_targets(_open(left, covered, sums=False), gone), "cover"), set(), open_ - len(covered) - first[0]["gain"]
            chosen.append(first[0]["grna"])
            continue
        sets = {r["grna"]: dict(zip(r["targets"], zip(r["s"], r["n"], strict=True), strict=True)) for r in _open(left.join(names, "grna", "left_semi"), covered, sums=False).select("grna", "targets", "s", "n").collect()}
        last = first[-1]
        picked, new = sure_picks(sets, {r["grna"]: (r["all"], r["all_pos"]) for r in first}, whole_pos, None if whole else (-last["gain"], last["pos"], last["red"], last["grna"]))
        chosen += picked
        covered |= new
        if whole or len(covered) >= open_:
            return chosen, None
        if 2 * len(covered) >= open_ or len(covered) > PAIRS:
            left, covered, open_ = stored(_open(left, covered, sums=False), "cover"), set(), open_ - len(covered)


def exclusive_sets(hits: DataFrame, n_sets: int = 1, targets: DataFrame | None = None, algorithm: str = "LAR", approve: Callable[[int, list[str]], Sequence[str]] | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """(set_number, grna): up to ``n_sets`` covering sets that share no guide.

    Each set covers all ``targets`` (target_id; default: those that the guides hit), or there
    are no more sets.  LAR breaks ties by positions on targets still uncovered, ``greedy`` by
    positions on all.  ``ranks`` (grna, rank) breaks them instead: of guides with equal gains
    the one of least rank (the least of several), then the first by name; guides without a
    rank come last.  ``approve`` is shown each set and returns the guides that it rejects:
    they leave the candidates, the others return to them, and the set is made anew.  Only
    a bounded part of a round's pairs comes to the driver, and of the sets the guides picked
    for several targets, or all where ``approve`` is to see them.
    """
    if algorithm not in ("LAR", "greedy"):
        raise ValueError(f"no such set cover: {algorithm!r}")
    pairs = (paired(hits) if ranks is None else ranked_pairs(hits, ranks)).where("target is not null")
    if targets is not None:
        asked = stored(targets.select(F.col("target_id").alias("target")).where("target is not null").distinct(), "cover")
        pairs = pairs.join(asked, "target", "left_semi")
    rows = stored(guide_rows(pairs), "cover")
    held = lambda some: some.select(F.explode("targets").alias("target")).distinct().count()
    n_targets, out, rejected = held(rows) if targets is None else asked.count(), [], []
    number, last = 1, None
    while number <= n_sets:
        free, used = rows, [g for _, g in out] + rejected
        if used:
            free = free.join(F.broadcast(hits.sparkSession.createDataFrame([(g,) for g in used], "grna string")), "grna", "left_anti")
        if last is not None:
            free = stored(free.join(merged_in_joins(last), "grna", "left_anti"), "cover")
        if not n_targets or held(free) < n_targets:
            break
        picked, rest = greedy_cover(free, n_targets, whole_pos=algorithm == "greedy")
        if approve and rest is not None:
            picked, rest = picked + sorted(r[0] for r in rest.collect()), None
        bad = set(approve(number, picked)) & set(picked) if approve else set()
        if bad:
            rejected += sorted(bad)
            continue
        out += [(number, g) for g in picked]
        if rest is not None:
            rest = rest.select(F.lit(number).alias("set_number"), "grna")
            last = rest if last is None else last.unionByName(rest)
        number += 1
    sets = hits.sparkSession.createDataFrame(out, "set_number int, grna string")
    return sets if last is None else sets.unionByName(last)


def one_from_each_group(groups: DataFrame, n_sets: int | None = None, from_3prime: bool = False) -> DataFrame:
    """(set_number, cg, grna): set i takes the i-th member of every group, nearest to 5'
    (or farthest from it) first."""
    order = Window.partitionBy("cg").orderBy(F.desc("pos") if from_3prime else F.col("pos"), "grna")
    size = F.count(F.lit(1)).over(Window.partitionBy("cg"))
    rows = groups.select("cg", "grna", F.row_number().over(order).alias("set_number"), size.alias("n"))
    limit = rows.agg(F.min("n").alias("full"))
    rows = rows.join(F.broadcast(limit), F.col("set_number") <= F.col("full"))  # one row
    return rows.select("set_number", "cg", "grna") if n_sets is None else rows.where(F.col("set_number") <= n_sets).select("set_number", "cg", "grna")


def redundancy(solution: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Per solution: elements listed, distinct elements and their difference; with a weight
    column (one value a member, named by column member) the solution's weight too."""
    per = solution.groupBy(*keys).agg(F.count("element").alias("listed"), F.countDistinct("element").alias("distinct_elements"))
    per = per.withColumn("redundancy", F.col("listed") - F.col("distinct_elements"))
    if weight is None:
        return per
    sums = solution.select(*keys, "member", weight).distinct().groupBy(*keys).agg(F.sum(weight).alias("weight"))
    return per.join(sums, list(keys))
