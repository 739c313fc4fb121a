"""Phrase collocations: frequent n-grams by hashed bucket counts and Apriori pruning.

Pass n counts the n-grams that may still be frequent exactly and, in the same reading of the
texts, counts the (n+1)-grams by hash bucket.  Buckets that reach the threshold become a
bitmap, broadcast to the next pass, which counts an n-gram only where its bucket is set and
both (n-1)-grams inside it are known to be frequent.  Bitmaps never miss, so the exact counts
that reach the threshold are all there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from strandline.operators.scratch import stored

#: Letters of A-Z are lower-cased; these bytes part words, these pieces.
BLANKS, BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
LONGEST = 4
#: Bits of a bitmap: a power of two by the bytes of the texts, within these (32 MB at most).
LEAST_BITS, MOST_BITS = 20, 28
#: Bytes of text that are cut into words at a time.
BLOCK_BYTES = 2 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Weights of a word's bytes by their place; words with more bytes are hashed one by one.
WEIGHTS = np.random.default_rng(20250117).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(BLANKS)] = 1
_CLASS[list(BREAKS)] = 2


def _stirred(a: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits mixed."""
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return a ^ (a >> np.uint64(33))


@dataclass
class Words:
    """The words of a block of texts."""

    names: pa.Array  # distinct words
    codes: np.ndarray  # of each word, its place in names
    piece: np.ndarray  # of each word, the number of its piece
    lang: np.ndarray  # of each word, its language's number
    hashes: np.ndarray  # of each distinct word

    def grams(self, n: int) -> np.ndarray:
        """First words of the n-grams: n words of one piece."""
        last = len(self.codes) - n + 1
        if last <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 :])

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        """A hash of language and words of the n-grams at ``at``."""
        key = _stirred(self.lang[at].astype(np.uint64) + np.uint64(n) * MIX)
        for k in range(n):
            key = _stirred(key * MIX + self.hashes[self.codes[at + k]])
        return key

    def distinct(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct n-gram (by language) of ``at``, and its count; exact."""
        ids, room = self.lang[at].astype(np.int64), int(self.lang.max(initial=0)) + 1
        for k in range(n):
            if room * len(self.names) >= 1 << 63:
                ids, room = _numbered(ids)
            ids, room = ids * len(self.names) + self.codes[at + k], room * len(self.names)
        ids, many = _numbered(ids)
        first = np.empty(many, np.int64)
        first[ids[::-1]] = at[::-1]
        return first, np.bincount(ids, minlength=many)

    def text(self, at: np.ndarray, n: int) -> pa.Array:
        """The n-grams at ``at``, their words parted by single blanks."""
        parts = [self.names.take(pa.array(self.codes[at + k], pa.int64())) for k in range(n)]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal numbers under equal ones from 0, and how many there are."""
    coded = pa.array(ids).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


def word_hashes(names: pa.LargeBinaryArray) -> np.ndarray:
    """A hash of each word (not empty): its bytes with a weight for each place, longer words
    one by one."""
    if not len(names):
        return np.empty(0, np.uint64)
    _, offsets, data = names.buffers()
    at = np.frombuffer(offsets, np.int64)[names.offset : names.offset + len(names) + 1]
    size, at, data = np.diff(at), at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    place = np.arange(len(data)) - np.repeat(at[:-1], size)
    out = np.add.reduceat((data + np.uint64(1)) * WEIGHTS[np.minimum(place, len(WEIGHTS) - 1)], at[:-1])
    for i in np.flatnonzero(size > len(WEIGHTS)):
        out[i] = xxh64_intdigest(names[i].as_py())
    return out


def words_of(texts: list[bytes], langs: list[int]) -> Words:
    """The words of ``texts`` (UTF-8), in order; a piece never spans two texts."""
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)  # bytes.lower() is A-Z only
    kind = _CLASS[data]
    word = kind == 0
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text = np.searchsorted(np.cumsum(sizes), start, "right")
    breaks = np.flatnonzero(kind == 2)
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[word]))])
    coded = names.dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(), np.searchsorted(breaks, start), np.array(langs, np.int64)[text] if len(langs) else np.empty(0, np.int64), word_hashes(coded.dictionary))


def _blocks(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[Words]:
    number = {x: i for i, x in enumerate(langs)}
    texts, which, size = [], [], 0
    for b in batches:
        for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            texts.append(data)
            which.append(number[lang])
            size += len(data)
            if size >= BLOCK_BYTES:
                yield words_of(texts, which)
                texts, which, size = [], [], 0
    if texts:
        yield words_of(texts, which)


def _set(bitmap: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bits of ``key`` are set."""
    at = key >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bitmap(buckets: DataFrame, bits: int) -> np.ndarray:
    """The buckets (bucket) as a bitmap of 2^``bits`` bits; segments are made on Spark."""
    out = np.zeros(max((1 << bits) // 8, 4096), np.uint8)
    at = F.col("bucket") + 1  # these functions count from 1
    segments = buckets.groupBy(F.bitmap_bucket_number(at).alias("s")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b"))
    for r in segments.toLocalIterator():  # 4 KB each
        out[(r.s - 1) * 4096 : r.s * 4096] = np.frombuffer(r.b, np.uint8)
    return out


def _counted(texts: DataFrame, langs: list[str], n: int, maps: dict, bits: int) -> DataFrame:
    """(kind, lang, phrase, bucket, c): counts of the n-grams that may be frequent, and of the
    buckets of longer ones whose parts may be, a row for each block of texts and each of both.

    ``maps``: broadcast bitmaps, "grams" of the frequent (n-1)-grams, "buckets" of n-grams.
    """
    grams, buckets = maps.get("grams"), maps.get("buckets")
    shift = np.uint64(64 - bits)

    def run(batches):
        for w in _blocks(batches, langs):
            at = w.grams(n)
            if n > 1:
                inner = _set(grams.value, w.keys(np.arange(len(w.codes) - n + 2), n - 1), bits) if len(at) else np.empty(0, bool)
                at = at[inner[at] & inner[at + 1]] if len(at) else at
                at = at[_set(buckets.value, w.keys(at, n), bits)]
            first, count = w.distinct(at, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(first), np.int32)), pa.array([langs[i] for i in w.lang[first]], pa.string()), w.text(first, n), pa.nulls(len(first), pa.int64()), pa.array(count.astype(np.int64))],
                names=["kind", "lang", "phrase", "bucket", "c"],
            )
            if n == LONGEST:
                continue
            longer = w.grams(n + 1)
            if n > 1:
                may = np.zeros(len(w.codes) + 1, bool)
                may[at] = True
                longer = longer[may[longer] & may[longer + 1]]
            bucket, count = np.unique(w.keys(longer, n + 1) >> shift, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(bucket), np.int32)), pa.nulls(len(bucket), pa.string()), pa.nulls(len(bucket), pa.string()), pa.array(bucket.astype(np.int64)), pa.array(count.astype(np.int64))],
                names=["kind", "lang", "phrase", "bucket", "c"],
            )

    return texts.mapInArrow(run, "kind int, lang string, phrase string, bucket long, c long")


def frequent_phrases(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f): all phrases of 1 to 4 words of which a language has at least
    ``least``; and (lang, n): all its words."""
    spark = documents.sparkSession
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    sizes = texts.groupBy("lang").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("n")).collect()  # one row a language
    langs = sorted(r["lang"] for r in sizes)
    bits = min(max((sum(r["n"] for r in sizes) // 16).bit_length(), LEAST_BITS), MOST_BITS)
    maps, found, totals = {}, None, None
    for n in range(1, LONGEST + 1):
        rows = stored(_counted(texts, langs, n, maps, bits).where("c > 0").groupBy("kind", "lang", "phrase", "bucket").agg(F.sum("c").alias("c")), f"grams{n}")
        if n == 1:
            totals = rows.where("kind = 0").groupBy("lang").agg(F.sum("c").alias("n"))
        grams = rows.where((F.col("kind") == 0) & (F.col("c") >= least)).select("lang", "phrase", F.lit(n).alias("words"), F.col("c").alias("f"))
        found = grams if found is None else found.unionByName(grams)
        for b in maps.values():
            b.unpersist()
        if n < LONGEST:
            marks = grams.mapInArrow(_gram_buckets(langs, n, bits), "bucket long")
            maps = {"grams": spark.sparkContext.broadcast(_bitmap(marks, bits)), "buckets": spark.sparkContext.broadcast(_bitmap(rows.where((F.col("kind") == 1) & (F.col("c") >= least)), bits))}
    return found, totals


def _gram_buckets(langs: list[str], n: int, bits: int):
    """The bits of the phrases of n words that are known to be frequent."""
    number = {x: i for i, x in enumerate(langs)}

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            phrases = [p.encode() for p in b.column("phrase").to_pylist()]
            split = [w for p in phrases for w in p.split(b" ")]
            coded = pa.array(split, pa.large_binary()).dictionary_encode()
            lang = np.repeat(np.array([number[x] for x in b.column("lang").to_pylist()], np.int64), n)
            w = Words(coded.dictionary, coded.indices.to_numpy(), np.empty(0), lang, word_hashes(coded.dictionary))
            yield pa.RecordBatch.from_arrays([pa.array((w.keys(np.arange(0, len(split), n), n) >> np.uint64(64 - bits)).astype(np.int64))], names=["bucket"])

    return run


def _exact(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def collocations(documents: DataFrame, least: int = 30, covered: int = 80, scale: int = 2_000_000, first: int = 2_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language (null:
    ``und``) by score, then count (both descending), then phrase in byte order.

    A phrase has 2 to 4 words of one piece of a text and stands ``least`` times or more; a is
    its count, l and r those of its two parts where it is cut so that floor(scale a / (l + r))
    is least, the first such cut.  Phrases inside a longer one that has ``covered`` % or more
    of their count are left out.  Null and empty texts have no words; a language without
    phrases has no row.  Repeated rows count as often as they stand.
    """
    found, totals = frequent_phrases(documents, least)
    found = stored(found, "phrases")
    count = lambda name, part: found.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    phrases = found.where("words > 1").withColumn("w", F.split("phrase", " "))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w", "words")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(count("l", "left"), ["lang", "left"]).join(count("r", "right"), ["lang", "right"])
    score = F.expr(f"cast(a as decimal(38,0)) * {scale} div (cast(l as decimal(38,0)) + r)").cast("long")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: part(i, size))))
    inside = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * covered))
    kept = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    ahead = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= first)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
