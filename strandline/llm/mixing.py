"""Mixing sources to target weights by fitting word budgets as subset sums."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.prefix import global_prefix
from strandline.operators.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
#: At least this many words, or ``WINDOW`` times the longest document's, are left to the
#: subset sum at the end.
FITTED = 8_192
WINDOW = 4
#: The subset sum has at most this many cells; of a longer budget a cell holds several words.
CELLS = 1 << 20

#: Sources whose totals are broadcast; more are joined by shuffling.
MOST_BROADCAST = 100_000


def source_targets(sizes: dict, weights: Sequence[int], most: int = 3) -> dict:
    """Share the total of ``sizes`` by weight among the sources (code-point order,
    null last); what exceeds ``most`` times a source goes to the others by weight."""
    ordered = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    target, free, left = {}, list(ordered), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    return target


def bounded_knapsack(counts: dict[int, int], budget: int, unit: int = 1) -> dict[int, int]:
    """How many of each length to take so that their sum is as near below ``budget``
    as possible, lengths counted in units of so many words and rounded up.  A sum is
    first reached by a bundle of one length from a sum that earlier bundles reached."""
    room = budget // unit
    reached, via, bundles = np.zeros(room + 1, bool), np.zeros(room + 1, np.int32), []
    reached[0] = True
    for length in sorted(counts, reverse=True):
        cells = -(-length // unit)
        left, size = min(counts[length], room // cells), 1
        while left > 0 and not reached[room]:
            size = min(size, left)
            new = reached[: room + 1 - size * cells] & ~reached[size * cells :]
            via[size * cells :][new] = len(bundles)
            reached[size * cells :] |= new
            bundles.append((length, size, size * cells))
            left, size = left - size, size * 2
        if reached[room]:
            break
    b, take = int(np.flatnonzero(reached)[-1]), defaultdict(int)
    while b:
        length, size, cells = bundles[via[b]]
        take[length] += size
        b -= cells
    return dict(take)


def fit_lengths(counts: dict[int, int], budget: float) -> dict[int, int]:
    """Documents to take of each exact length so that their words come near ``budget``:
    the same share of all lengths (systematic rounding from the longest down) for all but
    ``FITTED`` words or ``WINDOW`` times the longest, and the rest by the bounded knapsack over what is not yet
    taken.  A rest of over ``CELLS`` words is first fitted in coarse units with lengths of at
    least 256 units, then what is still open with all lengths that fit it."""
    left = int(round(budget))
    counts = {length: n for length, n in counts.items() if n > 0 and length <= left}
    total = sum(length * n for length, n in counts.items())
    if total <= left:
        return counts
    share = max(0.0, (left - max(FITTED, WINDOW * max(counts))) / total)
    take, owed = {}, 0.0
    for length in sorted(counts, reverse=True):
        owed += counts[length] * share
        take[length] = min(int(owed), counts[length])
        owed -= take[length]
    left -= sum(length * n for length, n in take.items())
    spare = {length: n - take[length] for length, n in counts.items()}
    unit = left // CELLS + 1
    fitted = bounded_knapsack({length: n for length, n in spare.items() if unit == 1 or length >= 256 * unit}, left, unit)
    if unit > 1:
        open_words = left - sum(length * n for length, n in fitted.items())
        after = {length: n - fitted.get(length, 0) for length, n in spare.items() if fitted or length < 256 * unit}
        for length, n in fit_lengths(after, open_words).items():
            fitted[length] = fitted.get(length, 0) + n
    for length, n in fitted.items():
        take[length] += n
    return take


def mixed_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_source: bool = False) -> DataFrame:
    """How often each document goes into a mix in which the sources hold ``weights``.

    A size is the number of words of the text (null: 0).  A source whose target is q
    whole passes and a rest takes its documents q - 1 times, and the words of the last
    pass and the rest from two copies of each (q = 0: from one): an equal share of every
    exact length, long ones too, then a subset sum.  Which documents of a length are taken
    follows a seeded hash of the id, so reruns agree.  Empty documents are never taken.  The
    histogram by (source, length) and the source totals are collected; n words hold at most
    sqrt(2 n) different lengths, so they do not grow with rows.

    Returns (id, size, source_size, target, taken), taken in words with repeats.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "mix")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    target = source_targets(sizes, weights, most)
    passes = {s: min(most, int(target[s] // n)) if n else 0 for s, n in sizes.items()}
    rest = {s: 0.0 if passes[s] >= most else target[s] - passes[s] * n for s, n in sizes.items()}

    histogram: dict = defaultdict(dict)
    filled = rows.where(F.col("size") > 0)
    for r in filled.groupBy("source", "size").count().collect():
        histogram[r["source"]][r["size"]] = r["count"]

    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, n, target[s]) for s, n in sizes.items()], "source string, source_size long, target double")
    takes = []
    for s, counts in histogram.items():
        held = 1 if 0 < passes[s] < most else 0  # the last whole pass is fitted with the rest
        again = fit_lengths({k: c * (1 + held) for k, c in counts.items()}, rest[s] + held * sizes[s])
        takes += [(s, k, passes[s] - held + again.get(k, 0) // c, again.get(k, 0) % c) for k, c in counts.items()]

    ranked = global_prefix(filled.withColumn("pick", F.xxhash64("id", F.lit(seed))), ["source", "size", "pick", "id"], [])
    groups = ranked.groupBy("source", "size").agg(F.min("row_before").alias("first"))
    wanted = spark.createDataFrame(takes, "s string, k long, each long, more long")
    ends = groups.join(wanted, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("k"))).select("s", "k", "each", (F.col("first") + F.col("more")).alias("end"))
    counted = ranked.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("k"))).select("id", "source", "size", (F.col("each") + (F.col("row_before") < F.col("end")).cast("long")).alias("times"))
    empty = rows.where(F.col("size") == 0).select("id", "source", "size", F.lit(0).cast("long").alias("times"))
    every = counted.unionByName(empty)
    per_source = plan.select(F.col("source").alias("s"), "source_size", "target")
    per_source = F.broadcast(per_source) if len(sizes) <= MOST_BROADCAST else per_source
    return every.join(per_source, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), *([F.col("source").alias(source_col)] if keep_source else [])
    )
