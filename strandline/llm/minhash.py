"""Near-duplicate detection by MinHash with tensored banding.

A few small collections of ``WIDTH`` minhashes each are computed for a document.  Every
pair of collections forms the key of one table: 13 collections (39 minhashes) serve 78
tables of six minhashes, where independent tables would need 468.  A pair of similarity s
meets if at least two collections agree.  The number of collections follows from the
threshold, so that a pair just at it is missed with probability ``MISS`` at most: 13 at
0.85 (9e-5; 2e-7 at 0.9), 17 at 0.80 (9e-5).  Candidates are confirmed on full sets.

Documents that meet are compared by parity sketches: bit h of a sketch is the parity of
the shingles hashed to h, so two sketches differ in at most as many bits as the sets
differ in shingles, and a pair whose sketches differ more can't reach the threshold.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.operators.scratch import stored

WIDTH, MISS = 3, 1e-4
#: Bits of a parity sketch.
BITS = 2_048
#: Large sets: pairs whose sketches differ by so many deviations more than sets just at the threshold are dropped.
DEVIATIONS = 4.5
#: Distinct words whose hashes a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Pivots with which a document is linked before members of buckets are compared.
PIVOTS = 4
#: Rows of a bucket that are compared with as many others at a time.
BLOCK = 2_048

_odd = np.random.default_rng(20240611).integers(1, 2**63, (64 * WIDTH, 2), dtype=np.uint64)
_MUL, _ADD = (_odd[:, 0] | np.uint64(1))[:, None], _odd[:, 1][:, None]
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_words: dict[bytes, int] = {}


@lru_cache
def collections_for(percent: int) -> int:
    """The fewest collections of which two agree at the threshold but for ``MISS``."""
    p = (percent / 100) ** WIDTH
    return next(c for c in range(2, 65) if (1 - p) ** c + c * p * (1 - p) ** (c - 1) <= MISS or c == 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K2
    return x ^ (x >> np.uint64(27))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word ``width``-grams of a text (ASCII letters
    lower-cased, words between ASCII white space); one of all words if they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    get = _words.get
    h = [get(w) for w in words]
    if None in h:
        for i, w in enumerate(words):
            if h[i] is None:
                h[i] = _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array(h, np.uint64)
    k = min(width, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _K1 + h[i : i + n])
    return np.unique(out)


def _signature(s: np.ndarray, hashes: int) -> np.ndarray:
    least = np.full((hashes, 1), np.uint64(2**64 - 1))
    for i in range(0, len(s), 4096):
        least = np.minimum(least, (s[None, i : i + 4096] * _MUL[:hashes] + _ADD[:hashes]).min(axis=1, keepdims=True))
    return least[:, 0]


def parity_sketch(s: np.ndarray) -> bytes:
    return np.packbits((np.bincount((_mixed(s * _K1) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def differences(percent: int, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The most bits in which sketches of sets of these sizes may differ; -1 where the sizes alone rule the similarity out."""
    most = (na + nb) * (100 - percent) // (100 + percent)
    p = (1 - (1 - 2 / BITS) ** most) / 2
    usual = BITS * p + DEVIATIONS * np.sqrt(BITS * p * (1 - p)) + 1
    return np.where(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb), np.minimum(most, usual), -1)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, BITS // 64)


def signatures(docs: DataFrame, width: int, collections: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, set_hash, keys, sketch): set size, 128-bit hash of the set, a key for each
    collection, and the parity sketch.  keys and sketch are null for no words."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sign(batches):
        for b in batches:
            n, sets, keys, sketches = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), width)
                n.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    parts = _signature(s, collections * WIDTH).reshape(collections, WIDTH)
                    k = np.zeros(collections, np.uint64)
                    for i in range(WIDTH):
                        k = _mixed(k * _K1 + parts[:, i])
                    keys.append(k.view(np.int64))
                    sketches.append(parity_sketch(s))
                else:
                    keys.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["id", "n", "set_hash", "keys", "sketch"])

    return rows.mapInArrow(sign, "id long, n long, set_hash binary, keys array<long>, sketch binary")


def bucketed(reps: DataFrame, collections: int) -> DataFrame:
    """(bucket, id) of the pair tables.  A collection's key that no other document has
    cannot meet in any table, so only shared keys are combined."""
    single = stored(reps.select("id", F.posexplode("keys").alias("c", "k")), "mhkeys")
    shared = single.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c", "k")
    kept = single.join(shared, ["c", "k"]).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("c", "k"))).alias("by"))  # as many as collections
    pairs = list(combinations(range(collections), 2))
    tables = F.array(*[F.when(F.col("by")[i].isNotNull() & F.col("by")[j].isNotNull(), F.xxhash64(F.lit(i * collections + j), F.col("by")[i], F.col("by")[j])) for i, j in pairs])
    return kept.where(F.size("by") > 1).select("id", F.explode(F.array_compact(tables)).alias("bucket"))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, ok): whether 100 * intersection >= percent * union of the full sets of a and b."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def check(batches):
        for b in batches:
            ok, last, u = [], None, None
            for a, x, y in zip(b.column("a").to_pylist(), b.column("ta"), b.column("tb"), strict=True):
                if a != last:
                    last, u = a, shingles(x.as_py(), width)
                v = shingles(y.as_py(), width)
                common = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                ok.append(100 * common >= percent * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return stored(both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long, ok boolean"), "mhlinks")


def block_partners(bucket: np.ndarray, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, sketch: np.ndarray, left: np.ndarray, asks: np.ndarray, percent: int, most: int):
    """(a, b, weight, more) of one block: for each asking row the ``most`` nearest left rows
    of other components whose sketches allow the similarity; more: it has others beyond."""
    q, c = np.flatnonzero(asks), np.flatnonzero(left)
    out = []
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        gap = np.zeros((len(part), len(c)), np.uint16)
        for w in range(sketch.shape[1]):
            gap += np.bitwise_count(sketch[part, w][:, None] ^ sketch[c, w][None])
        limit = differences(percent, n[part][:, None], n[c][None])
        weight = np.where((gap <= limit) & (comp[part][:, None] != comp[c][None]), gap / np.maximum(limit, 1), 9.0)
        held = (weight < 9).sum(axis=1)
        for r in np.flatnonzero(held):
            k = min(most, int(held[r]))
            near = np.argpartition(weight[r], k - 1)[:k] if k < len(c) else np.flatnonzero(weight[r] < 9)
            x = int(ids[part[r]])
            out.extend((int(bucket[part[r]]), min(x, int(ids[c[j]])), max(x, int(ids[c[j]])), bool(held[r] > k)) for j in near)
    return out


def partners(blocks: DataFrame, percent: int, most: int) -> DataFrame:
    """(bucket, a, b, more) by ``block_partners`` of rows (bucket, piece, turn, id, comp, n,
    sketch, left, asks); the rows of a block stand together and stream by, two blocks at most."""
    keys = ["bucket", "piece", "turn"]
    rows = blocks.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def found(table: pa.Table):
            cols = [table.column(i).to_numpy() for i in (0, 1, 2, 3, 4, 5, 7, 8)]
            sketch = _sketches(table.column(6))
            new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)]) if len(sketch) else np.empty(0, np.int64)
            ends = np.r_[new[1:], len(sketch)]
            bucket, _, _, ids, comp, n, left, asks = cols
            two = new[(ends - new == 2)]
            # blocks of two rows, the most by far, all at once
            ok = (comp[two] != comp[two + 1]) & (np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(axis=1) <= differences(percent, n[two], n[two + 1]))
            two = two[ok]
            out = list(zip(bucket[two].tolist(), np.minimum(ids[two], ids[two + 1]).tolist(), np.maximum(ids[two], ids[two + 1]).tolist(), [False] * len(two), strict=True))
            for s, e in zip(new.tolist(), ends.tolist(), strict=True):
                if e - s > 2:
                    out.extend(block_partners(bucket[s:e], ids[s:e], comp[s:e], n[s:e], sketch[s:e], left[s:e], asks[s:e], percent, most))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 4, types, strict=True)], names=["bucket", "a", "b", "more"])

        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([*held, b])
            last = [table.column(i)[-1].as_py() for i in range(3)]
            same = np.all([table.column(i).to_numpy() == v for i, v in enumerate(last)], axis=0)
            start = int(np.flatnonzero(same)[0])
            held = table.slice(start).to_batches()
            if start:
                yield found(table.slice(0, start))
        if held:
            yield found(pa.Table.from_batches(held))

    return rows.select("bucket", "piece", "turn", "id", "comp", "n", "sketch", "left", "asks").mapInArrow(compare, "bucket long, a long, b long, more boolean")


def _component_key(component: str) -> Column:
    """The number under which a component is held in blocks, among those of buckets."""
    return F.xxhash64(F.lit("component"), component)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (bucket, id, comp, left, asks) dealt into blocks of bounded size in which each
    asking row meets each left one once, so a bucket of any size is dealt to as many tasks
    as it needs."""
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count_if("left") / BLOCK).cast("int").alias("pieces"), F.ceil(F.count_if("asks") / BLOCK).cast("int").alias("turns"))
    piece, turn = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("turns")).cast("int")
    at = lambda p, t, left, asks: F.struct(p.alias("piece"), t.alias("turn"), left.alias("left"), asks.alias("asks"))
    asked = F.filter(F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda t: at(piece, t, F.col("left"), F.col("asks") & (t == turn))), lambda x: x["left"])
    asking = F.filter(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: at(p, turn, F.lit(False), F.col("asks"))), lambda x: x["asks"] & ~(F.col("left") & (x["piece"] == piece)))
    return rows.join(sizes, "bucket").select("bucket", "id", "comp", F.explode(F.concat(asked, asking)).alias("x")).select("bucket", "id", "comp", "x.*")


def blocked(placed: DataFrame, brief: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``partners`` for buckets (bucket, id, comp) with several components, and these
    buckets with their largest component (bucket, main).

    Members of other components ask those of their bucket's other components, and they ask
    the whole largest one, once however many buckets they share with it: a group of near
    copies stands in most tables, and its rows are not repeated for each of them."""
    sizes = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("main")).where("comps > 1")
    mixed = stored(mixed, "mhmixed")
    asking = stored(placed.join(mixed, "bucket").where("comp != main"), "mhasking")
    yes, no = F.lit(True), F.lit(False)
    among = asking.where("comps > 2").select("bucket", "id", "comp", yes.alias("left"), yes.alias("asks"))
    to_main = asking.select("main", "id", "comp").distinct().select(_component_key("main").alias("bucket"), "id", "comp", no.alias("left"), yes.alias("asks"))
    whole = placed.select("id", "comp").distinct().join(asking.select(F.col("main").alias("comp")).distinct(), "comp")
    whole = whole.select(_component_key("comp").alias("bucket"), "id", "comp", yes.alias("left"), no.alias("asks"))
    return _dealt(among.unionByName(to_main).unionByName(whole)).join(brief, "id"), mixed.select("bucket", "main")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Equal sets are collapsed first, so exact copies cost one representative.  Each member
    of a bucket is first compared with one member chosen by hash; the nearest few of these
    that a document has are confirmed and linked.  Then, in rounds, each member of a bucket that still
    holds several components is compared with all members of other components (of the
    bucket's largest one with all that it has anywhere), and its
    nearest possible partners are confirmed: 32 in the first round, sixteen times as many in
    each later one, until no bucket has a possible pair left.  So every pair that meets in a
    table is either linked, ruled out, or inside one component; pairs are never listed
    beyond the few nearest of each member.

    Ids must be integers; rows without one are in no component and are kept.  Null and empty texts have no shingles, are linked with nothing
    and are kept.  Repeated rows with the same id share the id's component; if their texts
    differ, the id counts with one of them.  Other columns play no part.
    """
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must hold integers")
    collections = collections_for(percent)
    signed = stored(signatures(docs, width, collections, id_col, text_col), "mhsig")
    reps = stored(signed.where("n > 0").groupBy("set_hash", "n").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")).dropDuplicates(["id"]), "mhreps")
    buckets = bucketed(reps, collections)
    order = F.xxhash64("id", F.pmod("bucket", F.lit(PIVOTS)))  # near copies share most buckets, and so most pivots
    pivots = buckets.groupBy("bucket").agg(F.min_by("id", order).alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket", "p")
    buckets = stored(buckets.join(pivots, "bucket"), "mhbuckets")
    brief = reps.select("id", "n", "sketch")
    met = buckets.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(met, "id", "left_semi")
    texts = stored(texts.dropDuplicates(["id"]), "mhtexts")

    # each member with its bucket's pivot
    first = buckets.where("id != p").select("id", "p").distinct()
    first = first.join(brief.select("id", F.col("n").alias("na"), F.col("sketch").alias("ka")), "id")
    first = first.join(brief.select(F.col("id").alias("p"), F.col("n").alias("nb"), F.col("sketch").alias("kb")), "p")

    def near(batches):
        for b in batches:
            gap = np.bitwise_count(_sketches(b.column("ka")) ^ _sketches(b.column("kb"))).sum(axis=1)
            limit = differences(percent, b.column("na").to_numpy(), b.column("nb").to_numpy())
            ok = np.flatnonzero(gap <= limit)
            weight = gap[ok] / np.maximum(limit[ok], 1)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ok)), b.column("p").take(pa.array(ok)), pa.array(weight, pa.float64())], names=["id", "p", "weight"])

    first = stored(first.select("id", "p", "na", "nb", "ka", "kb").mapInArrow(near, "id long, p long, weight double"), "mhfirst")
    place = F.row_number().over(Window.partitionBy("id").orderBy("weight", F.xxhash64("p"), "p"))  # as many as tables
    best = first.withColumn("k", place).where(F.col("k") <= PIVOTS).select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
    tested = confirmed(best, texts, width, percent)
    found = stored(components(tested.where("ok").select("a", "b")), "mhcomp")

    # members with those of other components of their buckets, until none is possible
    open_, most = buckets.select("bucket", "id"), 32
    while True:
        placed = stored(open_.join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp")), "mhplaced")
        blocks, mixed = blocked(placed, brief)
        pairs = stored(partners(blocks, percent, most), "mhpairs")
        new = pairs.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        links = confirmed(new, texts, width, percent)
        tested = tested.unionByName(links)
        if not links.isEmpty():
            found = stored(components(tested.where("ok").select("a", "b")), "mhcomp")
        more = stored(pairs.where("more").select("bucket").distinct(), "mhmore")
        if more.isEmpty():
            break
        again = mixed.select("bucket", F.explode(F.array("bucket", _component_key("main"))).alias("more")).join(more.withColumnRenamed("bucket", "more"), "more", "left_semi")
        open_, most = buckets.join(again.select("bucket").distinct(), "bucket", "left_semi").select("bucket", "id"), most * 16

    classes = reps.select("set_hash", "n", F.col("id").alias("rep")).join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", "n", F.coalesce("component", "rep").alias("comp"))
    out = signed.select("id", "n", "set_hash").join(classes, ["set_hash", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
