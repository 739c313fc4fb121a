"""Approximate nearest neighbours by balanced posting lists.

Many small lists: centroids are fitted on a bounded sample by balanced clustering in two
levels and joined to a neighbour graph that every task searches in memory.  A vector goes to
the list of its nearest centroid and, on a boundary, to others nearly as near (unless one
already chosen has nearly the same centroid).  A query reads its nearest lists, a fixed number
at most, whose distance is within a ratio of the nearest one's.  The index is fitted on
``FIT_PER_LIST`` vectors a list at most; every vector is indexed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.scratch import stored

#: Vectors for a list, the most lists, and vectors of a list that the index is fitted on.  Up
#: to ``MOST_LISTS * LIST_ROWS`` vectors lists keep their size; beyond, they grow with the table.
LIST_ROWS, MOST_LISTS, FIT_PER_LIST = 4, 65_536, 4
#: Numbers of the sample that is collected, at most (64 MB); long vectors have fewer lists.
FIT_NUMBERS = 1 << 24
#: Lists that a vector goes to and that a query reads, at most.
REPLICAS, PROBES = 4, 300
#: Two centroids of a vector are nearly the same within this share of its distance.
SHADOW = 0.1
#: Rows of a group of lists, and queries of one, that one task compares at a time.
LIST_BLOCK, QUERY_BLOCK = 8_192, 4_096
#: Vectors that walk the graph together.
WALKERS = 256


@dataclass
class Index:
    """Unit centroids with their groups, the group's number of each, its nearest other
    centroids, and for each group's middle the centroid nearest to it."""

    centroids: np.ndarray
    group: np.ndarray
    graph: np.ndarray
    middles: np.ndarray
    entry: np.ndarray

    def nearest(self, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, centroids) of the k best that best-first walks over the graph meet, a
        row for each of the unit vectors ``v``; walks start at the nearest groups."""
        c = self.centroids
        k = min(k, len(c))
        width, begin = min(len(c), k + 40), min(16, len(self.entry))
        out = []
        for lo in range(0, len(v), WALKERS):
            x = v[lo : lo + WALKERS].astype(c.dtype)
            rows = np.arange(len(x))[:, None]
            start = self.entry[np.argpartition(-(x @ self.middles.T), begin - 1, axis=1)[:, :begin]]
            seen = np.zeros((len(x), len(c) + 1), bool)
            at = np.full((len(x), width), len(c))
            dist = np.full((len(x), width), np.inf, c.dtype)
            at[:, :begin], dist[:, :begin] = start, 1 - np.einsum("rkd,rd->rk", c[start], x)
            seen[rows, start] = True
            walked = np.zeros((len(x), width), bool)
            many = max(4, width // 16)
            while True:
                left = np.where(walked, np.inf, dist)
                step = np.argpartition(left, min(many, width) - 1, axis=1)[:, :many]
                alive = np.isfinite(np.take_along_axis(left, step, 1))
                if not alive.any():
                    break
                np.put_along_axis(walked, step, True, 1)
                new = np.where(alive[:, :, None], self.graph[np.take_along_axis(at, step, 1)], len(c)).reshape(len(x), -1)
                new.sort(axis=1)
                new[:, 1:][new[:, 1:] == new[:, :-1]] = len(c)  # met twice in this step
                new[seen[rows, new]] = len(c)
                seen[rows, new] = True
                seen[:, -1] = True
                far = np.full(new.shape, np.inf, c.dtype)
                r, j = np.nonzero(new < len(c))
                far[r, j] = 1 - np.einsum("nd,nd->n", c[new[r, j]], x[r])
                at, dist, walked = np.hstack([at, new]), np.hstack([dist, far]), np.hstack([walked, np.zeros(new.shape, bool)])
                best = np.argpartition(dist, width - 1, axis=1)[:, :width]
                at, dist, walked = (np.take_along_axis(z, best, 1) for z in (at, dist, walked))
            order = np.lexsort((at, dist))[:, :k]
            out.append((np.take_along_axis(dist, order, 1), np.take_along_axis(at, order, 1)))
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _clustered(x: np.ndarray, lists: int, rng: np.random.Generator, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres of ``lists`` balanced clusters and the cluster of each row: a cluster's
    penalty grows with its share of the rows."""
    c = x[rng.choice(len(x), lists, replace=False)]
    size = np.full(lists, len(x) / lists)
    for _ in range(rounds):
        penalty = 0.05 * (size * lists / len(x) - 1)
        to = np.concatenate([(x[i : i + 4096] @ c.T - penalty).argmax(axis=1) for i in range(0, len(x), 4096)])
        size = np.bincount(to, minlength=lists).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, to, x)
        length = np.linalg.norm(total, axis=1)
        good = length > 1e-9
        c = np.where(good[:, None], total / np.maximum(length, 1e-9)[:, None], c).astype(x.dtype)
    return c, to


def fit_index(sample: np.ndarray, lists: int, seed: int = 5, degree: int = 24) -> Index:
    """Groups of lists, lists within each group, and links between lists of near groups."""
    x = np.unique(sample.astype(np.float32), axis=0)
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    middles, to = _clustered(x, max(1, round(lists**0.5)), rng, 8)
    found, group = [], []
    for g in range(len(middles)):
        mine = x[to == g]
        if len(mine):
            share = max(1, min(len(mine), round(lists * len(mine) / len(x))))
            found.append(_clustered(mine, share, rng, 3)[0])
            group += [g] * share
    c, group = np.concatenate(found), np.array(group)
    near = np.argsort(-(middles @ middles.T), axis=1)[:, : max(12, len(middles) // 3)]
    graph = np.zeros((len(c) + 1, min(degree, len(c))), np.int64)
    entry = []
    for g in np.unique(group):
        mine = np.flatnonzero(group == g)
        others = np.flatnonzero(np.isin(group, near[g]))
        close = c[mine] @ c[others].T
        close[others[None, :] == mine[:, None]] = -2
        some = min(graph.shape[1], len(others))
        graph[mine, :some] = others[np.argpartition(-close, some - 1, axis=1)[:, :some]]
        graph[mine, some:] = mine[:, None]
        entry.append(mine[(c[mine] @ middles[g]).argmax()])
    used = np.unique(group)
    return Index(c, group.astype(np.int32), graph, middles[used], np.array(entry))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that are not null, not zero and finite."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows multiplied by powers of two, which changes no digit, so that squares don't overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of q with every row of x, in double precision, each row by itself."""
    q, x = _scaled(q), _scaled(x)
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1)))


def nearest_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", replicas: int = REPLICAS, probes: int = PROBES, boundary: float = 4.0, ratio: float = 6.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``every``
    the ``k`` nearest others found, by cosine, ties to the smaller id.

    Null, zero and non-finite vectors take no part.  Vectors are searched among those of
    their own length.  Repeated ids count as one vector, the least of theirs.  A query whose
    lists hold fewer than ``k`` others is held against all vectors, so it gets fewer only
    where there are no more.
    """
    rows = stored(usable(vectors, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")), "annrows")
    schema = f"query_id long, rank int, {id_col} long, score double"
    out = vectors.sparkSession.createDataFrame([], schema)
    for r in rows.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():
        part = rows.where(F.size("v") == r["dim"]) if r["count"] else rows
        found = _searched(part, r["count"], r["dim"], k, every, replicas, probes, boundary, ratio)
        out = out.unionByName(found.select("query_id", "rank", F.col("id").alias(id_col), "score"))
    return out


def _best(ids: np.ndarray, x: np.ndarray, unit: np.ndarray, q: int, v: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k rows nearest to v, other than q itself."""
    near = unit @ _unit(v[None])[0]
    near[ids == q] = -9
    m = min(k, len(near))
    cut = np.partition(near, len(near) - m)[len(near) - m]
    some = np.flatnonzero((near >= cut - 1e-9) & (near > -2))
    score = cosines(v, x[some])
    return [(q, int(ids[some[j]]), float(score[j])) for j in np.lexsort((ids[some], -score))[:k]]


def postings(rows: DataFrame, n: int, dim: int, every: int, replicas: int, probes: int, boundary: float, ratio: float) -> tuple[DataFrame, DataFrame]:
    """(group, list, id): the lists that each of n vectors (id, v) goes to, and those that each
    query reads."""
    lists = max(1, min(MOST_LISTS, n // LIST_ROWS, FIT_NUMBERS // (FIT_PER_LIST * dim)))
    share = min(1.0, max(FIT_PER_LIST * lists, 2_000) / n)
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    sample = (rows.where(u < share) if share < 1 else rows).select("v").toArrow()["v"].combine_chunks()
    fitted = _unit(_matrix(sample)) if len(sample) else _unit(np.array([rows.first()["v"]]))
    shared = rows.sparkSession.sparkContext.broadcast(fit_index(fitted, lists))  # MOST_LISTS centroids at most

    def post(batches):
        """Each vector's lists: the nearest, and boundary ones; of centroids much nearer to
        each other than to the vector only the first."""
        ix = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v = _unit(_matrix(b.column(1)))
            dist, at = ix.nearest(v, 2 * replicas)
            c = ix.centroids[at]
            apart = 1 - np.einsum("rid,rjd->rij", c, c)
            chosen = np.zeros(at.shape, bool)
            for j in range(at.shape[1]):
                shadowed = (chosen & (apart[:, :, j] < SHADOW * dist[:, j : j + 1])).any(1)
                chosen[:, j] = (dist[:, j] <= boundary * dist[:, 0] + 1e-6) & ~shadowed & (chosen.sum(1) < replicas)
            row, j = np.nonzero(chosen)
            to = at[row, j]
            yield pa.RecordBatch.from_arrays([pa.array(ix.group[to]), pa.array(to.astype(np.int32)), b.column(0).take(pa.array(row))], names=["group", "list", "id"])

    def probe(batches):
        ix = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, WALKERS):
                part = b.slice(lo, WALKERS)
                dist, at = ix.nearest(_unit(_matrix(part.column(1))), probes)
                row, j = np.nonzero((dist <= ratio * dist[:, :1] + 1e-6) | (np.arange(dist.shape[1]) < 8))  # eight at least
                to = at[row, j]
                yield pa.RecordBatch.from_arrays([pa.array(ix.group[to]), pa.array(to.astype(np.int32)), part.column(0).take(pa.array(row))], names=["group", "list", "id"])

    kind = "group int, list int, id long"
    posted = stored(rows.select("id", "v").mapInArrow(post, kind), "annpost")
    asked = stored(rows.where(F.col("id") % every == 0).select("id", "v").mapInArrow(probe, kind), "annask")
    return posted, asked


def _searched(rows: DataFrame, n: int, dim: int, k: int, every: int, replicas: int, probes: int, boundary: float, ratio: float) -> DataFrame:
    """(query_id, rank, id, score) of n usable vectors (id, v) of one length."""
    posted, asked = postings(rows, n, dim, every, replicas, probes, boundary, ratio)

    # blocks: a group of lists of any size is dealt to as many tasks as it needs
    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list] = {}
        if len(a) and len(b):
            a = a.sort_values(["list", "id"])
            ids, x = a["id"].to_numpy(), np.stack(a["v"].to_numpy())
            unit, lists = _unit(x), a["list"].to_numpy()
            for q, mine in b.groupby("id"):
                lo, hi = (np.searchsorted(lists, mine["list"], side) for side in ("left", "right"))
                at = np.concatenate([np.arange(i, j) for i, j in zip(lo, hi, strict=True)])
                at = at[np.unique(ids[at], return_index=True)[1]]
                if len(at):
                    out[q] = _best(ids[at], x[at], unit[at], q, np.asarray(mine["q"].iloc[0]), k)
        return pd.DataFrame([r for found in out.values() for r in found], columns=["query_id", "id", "score"])

    keys = ["group", "piece", "turn"]
    plan = stored(blocks(posted, LIST_BLOCK, "pieces").join(blocks(asked, QUERY_BLOCK, "turns"), "group"), "annplan")  # a row for each group
    left = posted.join(F.broadcast(plan), "group").join(rows, "id").select("group", F.pmod(F.xxhash64("id"), "pieces").cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "list", "id", "v")
    asking = rows.select("id", F.col("v").alias("q"))
    right = asked.join(F.broadcast(plan), "group").join(asking, "id").select("group", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("id", F.lit(1)), "turns").cast("int").alias("turn"), "list", "id", "q")
    compared = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, id long, score double")
    found = stored(compared.groupBy("query_id", "id").agg(F.max("score").alias("score")), "annfound")
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, n - 1)).select(F.col("query_id").alias("id"))
    short = stored(rows.where(F.col("id") % every == 0).join(enough, "id", "left_anti"), "annshort")
    if n > 1 and not short.isEmpty():
        found = found.unionByName(_against_all(short, rows, n, k)).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _against_all(queries: DataFrame, rows: DataFrame, n: int, k: int) -> DataFrame:
    """(query_id, id, score): the k nearest of all rows in each block of rows, for each query."""
    pieces = max(1, n // LIST_BLOCK)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            ids, x = a["id"].to_numpy(), np.stack(a["v"].to_numpy())
            unit = _unit(x)
            out = [r for q, v in zip(b["id"], b["v"], strict=True) for r in _best(ids, x, unit, q, np.asarray(v), k)]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    piece = F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int").alias("piece")
    left, right = rows.select(piece, "id", "v"), queries.select(F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), "id", "v")
    return left.groupBy("piece").cogroup(right.groupBy("piece")).applyInPandas(compare, "query_id long, id long, score double")
