"""Order MinHash fingerprints of whole texts, in DataFrame functions only.

A text's k-mers are numbered by occurrence, hashed, and dealt into bins by their hash; the
least few of each bin, in the order in which they stand in the text, give the bin's part of
the fingerprint.  Two texts agree in a bin where they share its least k-mers in one order,
so the likeness falls both with k-mers exchanged and with k-mers moved, as edit distance does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a k-mer, bins (at most 64), and least k-mers taken of each.
KMER, BINS, LEAST = 12, 64, 2
#: Lower bits of a number that hold a place in a text; the highest six tell the bin.
PLACE = 31
#: Bits of a bin's part of the fingerprint, below the bin.
PART = 18
#: Documents of a range within which the next document is looked up, and ranges at most.
RANGE_ROWS, MOST_RANGES = 256, 16_384


def _once(value: Column, use) -> Column:
    """``use`` of ``value``, which is read from its row once and not for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _alike(x: Column, y: Column, bits: int) -> Column:
    """Whether two numbers agree above their lower ``bits``; null where one is missing."""
    return F.shiftrightunsigned(x.bitwiseXOR(y), bits) == 0


def _kmers(data: Column) -> Column:
    """(hash, place) in one number for each k-mer of the bytes ``data``, sorted: k-mers of one
    hash stand together, in text order.  Fewer bytes than a k-mer's are one k-mer, none have
    none."""
    n = F.octet_length(data)
    places = F.when(n > 0, F.sequence(F.lit(1).cast("long"), F.greatest(n - KMER + 1, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.sort_array(_once(data, lambda d: F.transform(places, lambda i: F.shiftleft(F.xxhash64(F.substring(d, i.cast("int"), KMER)), PLACE).bitwiseOR(i))))


def _occurrence(kmers: Column, x: Column, at: Column) -> Column:
    """The number (from 1) of ``x`` at ``at`` among the k-mers of its hash: the second and
    third by looking, others by halving steps back to the first."""
    same = lambda place: _alike(F.get(kmers, place), x, PLACE)
    steps = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)])
    first = F.aggregate(steps, at, lambda place, s: F.when(same(place - s), place - s).otherwise(place))
    return F.when(same(at - 3), at - first + 1).when(same(at - 2), 3).otherwise(2)


def _ranked(kmers: Column) -> Column:
    """(bin, rank, place) in one number for each occurrence-numbered k-mer, sorted: the first
    of its kind is ranked by its hash, the others by a hash of that and their number."""

    def one(k: Column, x: Column, at: Column) -> Column:
        again = F.xxhash64(F.shiftrightunsigned(x, PLACE), _occurrence(k, x, at))
        moved = F.shiftleft(again, PLACE).bitwiseOR(x.bitwiseAND((1 << PLACE) - 1))
        return F.when(_alike(F.get(k, at - 1), x, PLACE), moved).otherwise(x)

    return F.sort_array(_once(kmers, lambda k: F.transform(k, lambda x, at: one(k, x, at))))


def _least(ranked: Column) -> Column:
    """The first ``LEAST`` of each bin."""
    return _once(ranked, lambda r: F.filter(r, lambda x, at: ~_alike(F.get(r, at - LEAST), x, 58).eqNullSafe(F.lit(True))))


def _tuples(least: Column) -> Column:
    """(bin, hash of its least k-mers in text order) in 24 bits, for each bin that has any."""
    turned = lambda x: F.shiftleft(x, 64 - PLACE).bitwiseOR(F.shiftrightunsigned(x, PLACE))

    def one(k: Column, x: Column, at: Column) -> Column:
        own = F.filter(F.slice(k, at + 1, LEAST), lambda y: _alike(x, y, 58))
        ranks = F.transform(F.sort_array(F.transform(own, turned)), lambda y: F.shiftleft(y, PLACE))
        part = F.xxhash64(ranks).bitwiseAND((1 << PART) - 1)
        return F.when(~_alike(F.get(k, at - 1), x, 58).eqNullSafe(F.lit(True)), F.shiftleft(F.shiftrightunsigned(x, 58), PART).bitwiseOR(part))

    return F.array_compact(_once(least, lambda k: F.transform(k, lambda x, at: one(k, x, at))))


def fingerprints(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with the fingerprint (array of longs, one for each bin that has a k-mer) of each
    text column that ``columns`` names, under the name that it maps to.  No text and an empty
    one have none; equal texts have equal fingerprints.

    K-mers are runs of bytes of the text's UTF-8, told apart by 33 bits of their hash.
    """
    for text, name in columns.items():
        df = df.withColumn(name, _kmers(F.coalesce(F.col(text), F.lit("")).cast("binary")))
        df = df.withColumn(name, _ranked(F.col(name)))
        df = df.withColumn(name, _least(F.col(name)))
        df = df.withColumn(name, _tuples(F.col(name)))
    return df


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins that either has in which both agree; 1 for two empty fingerprints."""
    bins = lambda x: F.transform(x, lambda y: F.shiftrightunsigned(y, PART))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(fingerprint: Column) -> Column:
    """Six hexadecimal digits for each bin."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def _ranges(docs: DataFrame) -> list[int]:
    """First ids of ranges of about ``RANGE_ROWS`` documents, ``MOST_RANGES`` of them at most."""
    n = docs.agg(F.count("id__").alias("n"), F.min("id__").alias("least")).first()
    many = min(max(n["n"] // RANGE_ROWS, 1), MOST_RANGES)
    if n["least"] is None:
        return []
    cuts = docs.agg(F.percentile_approx("id__", [i / many for i in range(1, many)] or [0.5], 10 * many).alias("cuts")).first()["cuts"]
    return [n["least"], *sorted(set(cuts if many > 1 else []) - {n["least"]})]


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next) for each document (doc_id, text); a null text counts as empty.

    The edited text is the document's with its last quarter (code points, rounded down)
    replaced by as many from the start of the next document, or all of that where it is
    shorter; the first follows the last.  A single document follows itself.  Documents
    without an id come first; those of one id, and repeated rows, are ordered by their text.

    The order is cut into ranges of ids, dealt out by number.  The documents with a range's
    first id are sent to the range before as well, so that each text is shuffled once and no
    range needs another.  Work per text is in its row: about 60 bytes of memory a byte.
    """
    docs = documents.select(F.col("doc_id").alias("id__"), F.coalesce("text", F.lit("")).alias("own"))
    cuts = _ranges(docs)
    firsts = F.split(F.lit(",".join(map(str, cuts))), ",").cast(f"array<{docs.schema['id__'].dataType.simpleString()}>")
    steps = [1 << b for b in range(max(len(cuts) - 1, 1).bit_length() - 1, -1, -1)]
    at = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda p, s: F.when((p + s < len(cuts)) & (F.get(firsts, p + s) <= F.col("id__")), p + s).otherwise(p))
    docs = docs.withColumn("range", F.coalesce(at, F.lit(0)) if len(cuts) > 1 else F.lit(0))
    last = max(len(cuts) - 1, 0)
    # The very first documents are those without an id, if there are any.
    head = docs.where("id__ is null").limit(1).isEmpty()
    is_first = (F.get(firsts, F.col("range")) == F.col("id__")) if cuts else F.lit(False)
    wraps = (F.col("id__") == F.lit(cuts[0]) if cuts else F.lit(False)) if head else F.col("id__").isNull()
    before = F.when(wraps, F.lit(last)).when(is_first & (F.col("range") > 0), F.col("range") - 1)
    places = F.array_compact(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")), F.when(before.isNotNull(), F.struct(before.alias("range"), F.when(wraps, 2).otherwise(1).alias("guest")))))
    dealt = docs.select("id__", "own", F.explode(places).alias("p")).select("id__", "own", "p.range", "p.guest")
    order = Window.partitionBy("range").orderBy("guest", F.asc_nulls_first("id__"), "own")
    part = F.floor(F.length("own") / 4).cast("int")
    rows = dealt.withColumn("after", F.lead("own").over(order)).where(F.col("guest") < 3)
    rows = rows.withColumn("edited", F.concat(F.substr("own", F.lit(1), F.length("own") - part), F.substr(F.coalesce("after", F.lit("")), F.lit(1), part)))
    rows = rows.drop("after")
    rows = fingerprints(rows, {"own": "f", "edited": "e"}).withColumn("g", F.lead("f").over(order)).where("guest = 0")
    return rows.select(
        F.col("id__").alias("doc_id"), F.length("own").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.coalesce("g", F.col("f"))).alias("near_next"),
    )
