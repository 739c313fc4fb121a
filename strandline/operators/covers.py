"""Weighted set covers: approximate ones as rounds on Spark, and searches for many covers
among collapsed groups (cg, targets), a group's weight being its number of targets.

The searches are combinatorial, so they are for panels of bounded size: over ``MOST_PAIRS``
pairs of groups and targets they raise ValueError, and the LAR cover remains.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from strandline.operators.coverage import CANDIDATES, PAIRS, collapsed, relative_position
from strandline.operators.scratch import stored

MOST_PAIRS = 200_000


def wc_ratio(weight: Column, own: Column, left: Column, penalty: float = 0.0) -> Column:
    """Weight for each element of ``left`` that the set ``own`` (arrays) covers; infinite for
    none.  A penalty adds its share of the ratio for each element of ``left`` not covered."""
    covered = F.size(F.array_intersect(left, own))
    ratio = weight / F.nullif(covered, F.lit(0))
    return F.coalesce(ratio + F.size(F.array_except(left, own)) * ratio * penalty, F.lit(float("inf")))


def _light_picks(left: DataFrame, top: list[Row]) -> tuple[list[str], bool]:
    """Picks among the first groups by (w / gain, -w, cg) that no other group can precede, and
    whether all groups were at hand.  A ratio only rises as targets get covered, so a waiting
    key whose gain is still right is right, and groups beyond the last key stay beyond it."""
    sums = list(accumulate(r["gain"] for r in top))
    first = top[: max(1, sum(n <= PAIRS for n in sums))]
    whole = len(first) == len(top) < CANDIDATES
    if len(first) == 1:
        return [first[0]["cg"]], whole
    names = left.sparkSession.createDataFrame([(r["cg"],) for r in first], "cg string")
    sets, weight, covered, picks = defaultdict(set), {r["cg"]: r["w"] for r in first}, set(), []
    for r in left.join(F.broadcast(names), "cg").select("cg", "target").collect():
        sets[r["cg"]].add(r["target"])
    key = lambda c, gain: (weight[c] / gain, -weight[c], c)
    last = key(first[-1]["cg"], first[-1]["gain"])
    heap = [key(c, len(targets)) for c, targets in sets.items()]
    heapq.heapify(heap)
    while heap and (whole or heap[0] <= last):
        old = heapq.heappop(heap)
        gain = len(sets[old[2]] - covered)
        if gain and key(old[2], gain) != old:
            heapq.heappush(heap, key(old[2], gain))
        elif gain:
            picks.append(old[2])
            covered |= sets[old[2]]
    return picks, whole


def approximate_cover(groups: DataFrame, penalty: float = 0.0, seed: str | None = None) -> DataFrame:
    """(step, cg): the set of least weight for each uncovered target, then the largest, then
    the first by name, again and again until all targets that the groups hold are covered.
    A seed is taken first.  A round aggregates on Spark and brings at most ``CANDIDATES``
    groups with ``PAIRS`` pairs to the driver, where all sure picks are made; with a penalty a
    round makes one pick, for ratios may then fall."""
    pairs = stored(groups.select("cg", F.size("targets").alias("w"), F.explode("targets").alias("target")).distinct(), "panel")
    left, out, whole = pairs, [], False
    while not whole:
        if seed is not None and not out:
            picks = [seed]
        else:
            per = left.groupBy("cg").agg(F.first("w").alias("w"), F.count(F.lit(1)).alias("gain"))
            ratio = F.col("w") / F.col("gain")
            if penalty:
                ratio = ratio + (left.select("target").distinct().count() - F.col("gain")) * ratio * penalty
            top = per.withColumn("r", ratio).orderBy("r", F.desc("w"), "cg").limit(1 if penalty else CANDIDATES).collect()
            if not top:
                break
            picks, whole = ([top[0]["cg"]], False) if penalty else _light_picks(left, top)
        out += picks
        gone = left.where(F.col("cg").isin(picks)).select("target").distinct() if len(picks) == 1 else left.join(F.broadcast(groups.sparkSession.createDataFrame([(c,) for c in picks], "cg string")), "cg", "left_semi").select("target").distinct()
        left = left if whole else stored(left.join(gone, "target", "left_anti"), "panel")
    return groups.sparkSession.createDataFrame(list(enumerate(out, 1)), "step int, cg string")


class Panel:
    """Groups as rows of bits, for searches in memory."""

    def __init__(self, names: list[str], targets: list[list[str]]):
        order = sorted(range(len(names)), key=lambda i: (-len(targets[i]), names[i]))
        self.names = [names[i] for i in order]
        column = {t: k for k, t in enumerate(sorted({t for ts in targets for t in ts}))}
        self.bits = np.zeros((len(order), -(-max(1, len(column)) // 64)), np.uint64)
        for row, i in enumerate(order):
            for t in targets[i]:
                self.bits[row, column[t] // 64] |= np.uint64(1 << column[t] % 64)
        self.weight = np.array([len(targets[i]) for i in order], np.int64)
        self.universe = np.bitwise_or.reduce(self.bits, axis=0) if len(order) else np.zeros(1, np.uint64)

    def approximate(self, allowed: np.ndarray, forced: tuple[int, ...], penalty: float) -> tuple[int, ...] | None:
        """Members of the approximate cover that holds ``forced``, or None where there is none."""
        left, chosen = self.universe.copy(), list(forced)
        for i in forced:
            left &= ~self.bits[i]
        while left.any():
            gain = np.bitwise_count(self.bits & left).sum(axis=1).astype(float)
            with np.errstate(divide="ignore"):
                ratio = np.where(allowed & (gain > 0), self.weight / gain, np.inf)
            ratio = ratio + (np.bitwise_count(left).sum() - gain) * ratio * penalty if penalty else ratio
            best = int(np.argmin(ratio))  # rows stand by size and name, so ties go as they should
            if not np.isfinite(ratio[best]):
                return None
            chosen.append(best)
            left &= ~self.bits[best]
        return tuple(chosen)

    def enumerated(self, most: int, allowed: np.ndarray, seed: int | None = None, penalty: float = 0.0) -> list[tuple[int, ...]]:
        """Up to ``most`` covers in order of weight: the best cover of every branch (a group
        forced in, those before it left out) waits in a priority queue."""
        queue, out, seen = [], [], set()

        def wait(forced: tuple[int, ...], ok: np.ndarray) -> None:
            if (cover := self.approximate(ok, forced, penalty)) is not None:
                heapq.heappush(queue, (int(self.weight[list(cover)].sum()), sorted(cover), cover, len(forced), len(queue), ok))

        wait(() if seed is None else (seed,), allowed)
        while queue and len(out) < most:
            _, key, cover, fixed, _, ok = heapq.heappop(queue)
            if tuple(key) in seen:
                continue
            seen.add(tuple(key))
            out.append(tuple(key))
            for i in range(fixed, len(cover)):
                rest = ok.copy()
                rest[list(cover[fixed : i + 1])] = False
                wait(cover[:i], rest)
        return out


def panel_of(groups: DataFrame) -> Panel:
    sets = groups.select("cg", "targets").distinct()
    if (sets.agg(F.sum(F.size("targets")).alias("n")).first()["n"] or 0) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of groups and targets: use the LAR cover")
    rows = sets.collect()
    return Panel([r["cg"] for r in rows], [list(r["targets"]) for r in rows])


def enumerated_covers(groups: DataFrame, most: int = 100, seed: str | None = None, penalty: float = 0.0) -> DataFrame:
    """(solution, cg): up to ``most`` covers of the panel, those of least weight first."""
    panel = panel_of(groups)
    at = panel.names.index(seed) if seed is not None else None
    found = panel.enumerated(most, np.ones(len(panel.names), bool), at, penalty)
    return groups.sparkSession.createDataFrame([(i, panel.names[m]) for i, c in enumerate(found, 1) for m in c], "solution int, cg string")


def limited_minweight(groups: DataFrame, n_sets: int, penalty: float = 0.0, lengths: int | None = None) -> DataFrame:
    """(solution, cg): covers of least weight seeded by every group in turn.

    Groups of one coverage are seeded together (a task each), from the largest coverage
    down; each gives max(20, 2 n_sets) covers at most and then leaves the candidates.  The
    search ends at a coverage below targets / (size of the ``lengths``-th smallest cover,
    max(10, 2 n_sets) by default); larger covers than that are left out.
    """
    spark, panel = groups.sparkSession, panel_of(groups)
    most, lengths = max(20, 2 * n_sets), max(10, 2 * n_sets) if lengths is None else lengths
    n = int(np.bitwise_count(panel.universe).sum())
    shared = spark.sparkContext.broadcast(panel)  # at most MOST_PAIRS bits
    covers: set[tuple[int, ...]] = {(i,) for i in np.flatnonzero(panel.weight == n)}
    sizes = sorted([n, *[1] * len(covers)])[:lengths]
    allowed = panel.weight < n
    for coverage in sorted({int(w) for w in panel.weight[allowed]}, reverse=True):
        if coverage < (1 if len(sizes) < lengths else n / sizes[-1]):
            break
        seeds, ok = np.flatnonzero(panel.weight == coverage), allowed.copy()

        def search(frames, ok=ok):
            p = shared.value
            for f in frames:
                found = [c for s in f["seed"] for c in p.enumerated(most, ok, int(s), penalty)]
                yield pd.DataFrame({"members": pd.Series([list(map(int, c)) for c in found], dtype=object)})

        rows = spark.createDataFrame([(int(s),) for s in seeds], "seed int").repartition(min(len(seeds), 64))
        new = {tuple(r["members"]) for r in rows.mapInPandas(search, "members array<int>").distinct().collect()}
        covers |= new
        sizes = sorted([*sizes, *[len(c) for c in new if len(c) <= sizes[-1]]])[:lengths]
        allowed[seeds] = False
    kept = sorted((c for c in covers if len(c) <= sizes[-1]), key=lambda c: (len(c), c))
    return spark.createDataFrame([(i, panel.names[m]) for i, c in enumerate(kept, 1) for m in c], "solution int, cg string")


def limited_optimal(groups: DataFrame, size: int = 1, redundancy: float = 1.0) -> DataFrame:
    """(solution, cg): all covers of at most ``size`` groups, each needed, in which targets
    are listed at most ``redundancy`` times their number too often.

    A partial cover grows by the groups that hold its first uncovered target (an equi-join),
    and goes when even the largest groups could not finish it in time.
    """
    sets = stored(groups.select("cg", F.array_sort(F.col("targets").cast("array<string>")).alias("targets")).distinct(), "panel")
    bounds = sets.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("targets")))).alias("u"), F.max(F.size("targets")).alias("most")).first()
    spark = groups.sparkSession
    if not bounds["u"]:
        return spark.createDataFrame([], "solution long, cg string")
    if len(bounds["u"]) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} targets: use the LAR cover")
    n, largest = len(bounds["u"]), bounds["most"]
    by_target = sets.select("cg", "targets", F.explode("targets").alias("next"))
    part = spark.createDataFrame([([], bounds["u"], 0)], "members array<string>, open array<string>, listed int")
    done = None
    for depth in range(1, size + 1):
        grown = part.withColumn("next", F.element_at("open", 1)).join(by_target, "next")
        grown = grown.select(F.array_sort(F.array_append("members", F.col("cg"))).alias("members"), F.array_except("open", "targets").alias("open"), (F.col("listed") + F.size("targets")).alias("listed"))
        grown = grown.where(F.col("listed") - (n - F.size("open")) <= redundancy * n).where(F.size("open") <= (size - depth) * largest)
        part = stored(grown.dropDuplicates(["members"]), "panel")
        full = part.where(F.size("open") == 0).select("members")
        done = full if done is None else done.unionByName(full)
        part = part.where(F.size("open") > 0)
    rows = done.distinct().withColumn("solution", F.xxhash64(F.array_join("members", "\0"))).select("solution", "members", F.explode("members").alias("cg"))
    held = rows.join(sets, "cg").select("solution", "cg", F.explode("targets").alias("target"))
    alone = held.groupBy("solution", "target").agg(F.count(F.lit(1)).alias("k"), F.min("cg").alias("cg")).where("k = 1").select("solution", "cg").distinct()
    needed = alone.groupBy("solution").agg(F.count(F.lit(1)).alias("needed"))
    whole = rows.groupBy("solution").agg(F.count(F.lit(1)).alias("m")).join(needed, "solution").where("m = needed").select("solution")
    return rows.join(whole, "solution").select("solution", "cg")


def nonredundant_sets(hits: DataFrame, n_sets: int = 1, penalty: float = 0.0, depth: int = 5, from_3prime: bool = False) -> DataFrame:
    """(set_number, grna): covering sets that share no guide, small and non-redundant first.

    Covers of least weight and all small covers are ranked by size, redundancy and largest
    group.  A set takes one guide, nearest to 5' (or 3'), of each group of the first ranked
    cover whose groups all have guides left; without such a cover they are found anew for
    the guides that are left.  Fewer sets are returned where no cover is left.
    """
    spark = hits.sparkSession
    placed = stored(collapsed(hits).join(relative_position(hits), "grna").select("cg", "grna", "targets", "pos"), "panel")
    everything = placed.select(F.explode("targets").alias("t")).distinct().count()
    out, used = [], set()

    def ranked(groups: DataFrame) -> list[list[str]]:
        light = limited_minweight(groups, n_sets, penalty)
        sets = {r["cg"]: frozenset(r["targets"]) for r in groups.collect()}  # a bounded panel
        found: dict = {}
        for r in light.collect():
            found.setdefault(r["solution"], []).append(r["cg"])
        covers = {tuple(sorted(c)) for c in found.values()}
        if not covers:
            return []
        over = lambda c: sum(len(sets[g]) for g in c) - len(frozenset().union(*(sets[g] for g in c)))
        small = limited_optimal(groups, min(depth, max(map(len, covers)), 3), max(map(over, covers)) / everything)
        for r in small.groupBy("solution").agg(F.collect_list("cg").alias("c")).collect():
            covers.add(tuple(sorted(r["c"])))
        return sorted(map(list, covers), key=lambda c: (len(c), over(c), -max(len(sets[g]) for g in c), c))

    queue: list[list[str]] = []
    members: dict[str, list[str]] = {}
    fresh = True
    while len(out) < n_sets:
        while queue and not all(any(g not in used for g in members[c]) for c in queue[0]):
            queue.pop(0)
        if not queue:
            if not fresh:
                break
            free = placed.join(spark.createDataFrame([(g,) for g in sorted(used)], "grna string"), "grna", "left_anti") if used else placed
            if free.select(F.explode("targets").alias("t")).distinct().count() < everything:
                break
            queue, fresh = ranked(free.select("cg", "targets").distinct()), False
            at = F.row_number().over(Window.partitionBy("cg").orderBy(F.desc("pos") if from_3prime else F.col("pos"), "grna"))
            asked = spark.createDataFrame([(c,) for c in {c for q in queue for c in q}] or [("",)], "cg string")
            members = {}
            for r in free.join(F.broadcast(asked), "cg").withColumn("k", at).where(F.col("k") <= n_sets).orderBy("cg", "k").collect():
                members.setdefault(r["cg"], []).append(r["grna"])
            continue
        picked = [next(g for g in members[c] if g not in used) for c in queue[0]]
        used.update(picked)
        out.append(picked)
        fresh = True
    return spark.createDataFrame([(i, g) for i, s in enumerate(out, 1) for g in s], "set_number int, grna string")
