"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS, BITS = (1, 2, 3), 16
#: The fit sees about this many documents of each language, chosen by hash of the id.
FIT_ROWS = 4_000
_KEYS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def hashed_ngrams(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each character (the last ones run into zeros)."""
    padded = np.concatenate([codes, np.zeros(order - 1, np.uint32)])
    h = np.full(len(codes), order, np.uint32)
    for i in range(order):
        h = (h ^ padded[i : i + len(codes)]) * np.uint32(_KEYS[i])
        h ^= h >> np.uint32(15)
    return h & np.uint32((1 << BITS) - 1)


def chunks(texts: list[str], most: int = 1_000_000):
    """(rows, codes, starts): lower-cased texts laid end to end, each followed by a zero."""
    at = 0
    while at < len(texts):
        parts, starts, size, first = [], [], 0, at
        while at < len(texts) and (not parts or size + len(texts[at]) <= most):
            codes = np.frombuffer(texts[at].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            starts.append(size)
            parts += [codes, np.zeros(2, np.uint32)]
            size += len(codes) + 2
            at += 1
        yield range(first, at), np.concatenate(parts), np.array(starts)


def language_model(docs: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities 2**BITS x languages) from about ``fit_rows`` rows of
    each language whose crc32(id as text) mod 5 is not 0.  Counts are added up by Spark;
    what is collected has at most 2**BITS rows for each language."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    n = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(n)
    if not langs:
        return [], np.zeros((1 << BITS, 0), np.float32)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, fit_rows / n[k])))])
    u = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(u < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches):
        for b in batches:
            texts, of = b.column(1).to_pylist(), b.column(0).to_pylist()
            for lang in set(of):
                total = np.zeros(1 << BITS, np.int64)
                for _, codes, _ in chunks([t for t, x in zip(texts, of, strict=True) if x == lang]):
                    real = codes != 0
                    for k in ORDERS:
                        total += np.bincount(hashed_ngrams(codes, k)[real], minlength=1 << BITS)
                hit = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["lang", "bucket", "n"])

    sums = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((1 << BITS, len(langs)), 0.5)
    for r in sums.toLocalIterator():
        counts[r["bucket"], langs.index(r["lang"])] += r["n"]
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def predicted_languages(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest language of each whole text and its share of
    the probability.  ``und`` with score 0 for null texts and texts without a letter, and
    where no language could be learned."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        langs, table = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            for at, codes, starts in chunks(texts):
                like = np.zeros((len(starts), len(langs)))
                real = (codes != 0)[:, None]
                for k in ORDERS:
                    like += np.add.reduceat(table[hashed_ngrams(codes, k)] * real, starts, axis=0, dtype=np.float64)
                if not langs:
                    continue
                share = np.exp(like - like.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1)
                for j, i in enumerate(at):
                    if any(map(str.isalpha, texts[i])):
                        pred[i], score[i] = langs[best[j]], float(share[j, best[j]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return rows.mapInArrow(predict, f"`{id_col}` {dict(rows.dtypes)['id']}, lang_pred string, score double")
