"""Toxic spans by a linear-chain conditional random field.

Tokens of labelled documents get labels by distant supervision: in a toxic document the
words that mark toxic documents, in a clean one none.  A mark is a whole word or a stem
(its first 4 or 5 letters) that many toxic documents hold, in many different contexts so
that copies of one text don't count.  The field has two states (clean, toxic); a token's
feature is the highest level of association of its word and stems, so the weights are
one row a level and a 2 x 2 transition matrix, fitted to the token labels.  Forward-backward
marginals give the toxic spans and, summed up by a logistic curve, the document's score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from strandline.operators.scratch import stored

WORD = re.compile(r"[^\W_]+")
LEVELS = 12
#: The fit sees about this many labelled documents of each class, chosen by hash of the id.
FIT_ROWS = 4_000
SPAN_AT = 0.5
STEMS = (4, 5)
#: Levels are steps of half a unit of log-odds; words and stems below this one are neutral.
MARK = 6
#: Tokens of a stretch that the fit walks at once, and the most stretches of a kind.
STRETCH, STRETCHES = 32, 3_000
#: Words whose levels a task remembers before it starts anew, and texts that it scores together.
REMEMBERED, TOGETHER = 100_000, 256
SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])


@dataclass
class ToxicModel:
    """Fitted values: levels of known words, state scores of levels, transitions, curve."""

    level: dict[str, int]
    emission: np.ndarray  # LEVELS x 2
    transition: np.ndarray  # 2 x 2
    curve: tuple[float, float]

    def marginals(self, levels: list[np.ndarray]) -> list[np.ndarray]:
        """P(toxic) of each token of each document."""
        emit, move = np.exp(self.emission), np.exp(self.transition)
        return forward_backward(levels, emit, move)

    def levels_of(self, words: list[str], memo: dict[str, int]) -> np.ndarray:
        missing = {w for w in words if w not in memo}
        for w in missing:
            memo[w] = max(self.level.get(k, NEUTRAL) for k in features(w))
        return np.array([memo[w] for w in words], np.int8)


def words_of(text: str) -> list[str]:
    """The words as they stand in the text, lower-cased.  Where that makes a text longer, it is
    done word by word, so the places of words are always those of the text."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def features(word: str) -> list[str]:
    """The word and its stems, as keys."""
    return [f"={word}", *(word[:k] for k in STEMS if len(word) > k)]


#: Level of words that the fit has not met or that tell nothing.
NEUTRAL = 0


def forward_backward(docs: list[np.ndarray], emit: np.ndarray, move: np.ndarray) -> list[np.ndarray]:
    """Marginals of state 1 for chains of different lengths.  Chains of similar length
    are laid side by side and walked together, scaled at every step."""
    out: list[np.ndarray] = [np.empty(0)] * len(docs)
    order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
    at = 0
    while at < len(order):
        chunk = [order[at]]
        at += 1
        while at < len(order) and len(chunk) < 1024 and len(docs[order[at]]) * (len(chunk) + 1) <= 1_500_000 and len(docs[order[at]]) <= 1.5 * len(docs[chunk[0]]) + 16:
            chunk.append(order[at])
            at += 1
        size = np.array([len(docs[i]) for i in chunk])
        n, m = int(size.max(initial=0)), len(chunk)
        if not n:
            continue
        grid = np.zeros((n, m), np.int8)
        for j, i in enumerate(chunk):
            grid[: size[j], j] = docs[i]
        odds = (emit[:, 1] / emit[:, 0])[grid]  # n x m
        ahead = np.empty((n, m))
        a = odds[0].copy()  # forward odds of state 1 against 0
        ahead[0] = a
        for t in range(1, n):
            a = (move[0, 1] + a * move[1, 1]) / (move[0, 0] + a * move[1, 0]) * odds[t]
            ahead[t] = a
        b = np.ones(m)  # backward odds
        for t in range(n - 2, -1, -1):
            x = odds[t + 1] * b
            step = (move[1, 0] + move[1, 1] * x) / (move[0, 0] + move[0, 1] * x)
            b = np.where(t + 1 < size, step, 1.0)
            ahead[t] *= b
        p = ahead / (1 + ahead)
        for j, i in enumerate(chunk):
            out[i] = p[: size[j], j]
    return out


def _summary(p: np.ndarray) -> float:
    """Expected number of toxic tokens within the spans, on a log scale."""
    return float(np.log1p(p[p >= SPAN_AT].sum()))


def likelihood_gradient(grid: np.ndarray, tags: np.ndarray, emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log-likelihood of ``tags`` over chains of one length (time x chain)."""
    n, m = grid.shape
    emit, move = np.exp(emission), np.exp(transition)
    e = emit[grid]  # n x m x 2
    alpha, beta = np.empty((n, m, 2)), np.ones((n, m, 2))
    alpha[0] = e[0]
    for t in range(1, n):
        alpha[t] = (alpha[t - 1] @ move) * e[t]
        alpha[t] /= alpha[t].sum(axis=1, keepdims=True)
    for t in range(n - 2, -1, -1):
        beta[t] = (e[t + 1] * beta[t + 1]) @ move.T
        beta[t] /= beta[t].sum(axis=1, keepdims=True)
    node = alpha * beta
    node /= node.sum(axis=2, keepdims=True)
    pair = alpha[:-1, :, :, None] * move * (e[1:] * beta[1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    g_e, g_t = np.zeros_like(emission), np.zeros_like(transition)
    np.add.at(g_e, (grid, tags), 1)
    np.add.at(g_t, (tags[:-1], tags[1:]), 1)
    for state in (0, 1):
        g_e[:, state] -= np.bincount(grid.ravel(), node[:, :, state].ravel(), len(emission))
    return g_e, g_t - pair.sum(axis=(0, 1))


def fitted_field(grid: np.ndarray, tags: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """State scores and transitions by gradient ascent on the likelihood of token labels."""
    emission, transition = np.zeros((LEVELS, 2)), np.zeros((2, 2))
    theta = [emission, transition]
    scale = [np.full_like(x, 1.0) for x in theta]
    for _ in range(rounds if grid.size else 0):
        for x, g, s in zip(theta, likelihood_gradient(grid, tags, *theta), scale, strict=True):
            g = g - 0.1 * x
            s += g * g
            x += 0.5 * g / np.sqrt(s)
    return emission, transition


def fitted_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method."""
    a, c = 1.0, 0.0
    for _ in range(50 if len(y) else 0):
        q = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        w = q * (1 - q) + 1e-6
        g = np.array([((y - q) * x).sum() - 0.01 * a, (y - q).sum() - 0.01 * c])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        a, c = a + float(np.clip(d[0], -2, 2)), c + float(np.clip(d[1], -2, 2))
        if abs(d).max() < 1e-6:
            break
    return a, c


def fitted_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Fit on about ``fit_rows`` labelled rows of each class whose crc32(id as text) mod 3
    is not 1: a bounded sample by hash, the same at every run.  Spark counts words and
    contexts and cuts the stretches; the driver gets the marks, ``STRETCHES`` stretches of
    each kind and a number for each document of the sample.  An id that has both labels
    counts as toxic.  Without labels every document gets the same score."""
    known = labels.where("toxic in (0, 1)").select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.crc32(F.col("id").cast("string")) % 3 != 1)
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    model = ToxicModel({}, np.zeros((LEVELS, 2)), np.zeros((2, 2)), (1.0, 0.0))
    if not n:
        return model
    share = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, fit_rows / v)))])
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(u < share[F.col("toxic")]).groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id")  # about fit_rows ids of each class
    sample = stored(rows, "toxfit").select("id", "toxic", "text")
    kind = dict(sample.dtypes)["id"]
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    least = max(3, n1 // 100)

    def held(batches):
        for b in batches:
            seen: dict[str, list[int]] = {}
            for label, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for key in {k for w in set(words_of(t)) for k in features(w)}:
                    seen.setdefault(key, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1)]], names=["key", "c0", "c1"])

    counted = sample.mapInArrow(held, "key string, c0 long, c1 long").groupBy("key").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    lift = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    marks = {r["key"]: r["lift"] for r in counted.where(F.col("c1") >= least).select("key", lift.alias("lift")).where(F.col("lift") >= MARK / 2).collect()}

    def contexts(batches):
        for b in batches:
            met = set()
            for t in b.column(2).to_pylist():
                ws = words_of(t)
                for i, w in enumerate(ws):
                    met.update((k, ws[i - 1] if i else "", ws[i + 1] if i + 1 < len(ws) else "") for k in features(w) if k in marks)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*met, strict=True) if met else ([], [], []))], names=["key", "before", "after"])

    varied = sample.where("toxic = 1").mapInArrow(contexts, "key string, before string, after string").distinct().groupBy("key").count().where(F.col("count") >= least)
    model.level = {r["key"]: int(np.clip(marks[r["key"]] / 0.5, 1, LEVELS - 1)) for r in varied.collect()}

    def stretches(batches):
        memo: dict[str, int] = {}
        for b in batches:
            at, grids, tags = [], [], []
            for row, (label, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                g = model.levels_of(words_of(t), memo)
                for i in range(0, len(g), STRETCH):
                    part = np.pad(g[i : i + STRETCH], (0, STRETCH - len(g[i : i + STRETCH])))
                    at.append((row, i))
                    grids.append(part.tobytes())
                    tags.append(((part >= MARK).astype(np.int8) * np.int8(label)).tobytes())
            ids = b.column(0).take(pa.array([r for r, _ in at], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i in at], pa.int32()), pa.array(grids, pa.binary()), pa.array(tags, pa.binary())], names=["id", "i", "grid", "tags"])

    parts = sample.mapInArrow(stretches, f"id {kind}, i int, grid binary, tags binary").withColumn("hit", F.locate(chr(1), F.col("tags").cast("string")) > 0)
    order = F.xxhash64("id", "i")
    some = parts.where("hit").orderBy(order).limit(STRETCHES).collect()
    some += parts.where("not hit").orderBy(order).limit(max(100, min(STRETCHES, len(some)))).collect()
    grid, tag = (np.frombuffer(b"".join(bytes(r[c]) for r in some), np.int8).reshape(-1, STRETCH).T for c in ("grid", "tags"))
    model.emission, model.transition = fitted_field(grid, tag)

    def sums(batches):
        memo: dict[str, int] = {}
        for b in batches:
            p = model.marginals([model.levels_of(words_of(t), memo) for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([_summary(q) for q in p], pa.float64())], names=["toxic", "x"])

    found = sorted(sample.mapInArrow(sums, "toxic int, x double").collect(), key=lambda r: (r["x"], r["toxic"]))
    model.curve = fitted_curve(np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found]))
    return model


def toxicity_scores(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("score", "spans")) -> DataFrame:
    """The columns ``keep`` (default: the id) of each row with its score and ``spans``, the
    offending (start, end) character offsets; ``names`` renames these two where ``keep`` has
    such columns.  Null and empty texts have no tokens and get the score of a document
    without toxic words.  Every row is scored by itself, repeated rows alike."""
    keep = keep or [id_col]
    own = "text__"
    while own in keep:
        own += "_"
    rows = docs.select(*keep, F.col(text_col).alias(own))
    schema = StructType([*docs.select(*keep).schema.fields, StructField(names[0], DoubleType()), StructField(names[1], ArrayType(SPAN))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [*keep, *names]

    def score(batches):
        m = shared.value
        a, c = m.curve
        memo: dict[str, int] = {}
        for b in batches:
            for lo in range(0, b.num_rows, TOGETHER):
                part = b.slice(lo, TOGETHER)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                if len(memo) > REMEMBERED:
                    memo.clear()
                p = m.marginals([m.levels_of(words_of(t), memo) for t in texts])
                scores, spans = [], []
                for t, q in zip(texts, p, strict=True):
                    scores.append(1 / (1 + np.exp(-np.clip(a * _summary(q) + c, -30, 30))))
                    hit = np.flatnonzero(q >= SPAN_AT)
                    if len(hit):
                        found = [x.span() for x in WORD.finditer(t)]
                        spans.append([{"start": found[i][0], "end": found[i][1]} for i in hit])
                    else:
                        spans.append([])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64()), pa.array(spans, kind)], names=columns)

    return rows.mapInArrow(score, schema)
