"""Lossless WebP images: an encoder for bytes and a decoder for any lossless stream.

The decoder reads prefix codes, back-references and the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms.  Streams of one channel, as
the encoder writes them, are decoded by table look-ups over all bit positions at once, from
one back-reference to the next, instead of symbol by symbol.  The encoder writes
back-references, predicts from the row above where that is shorter, and gives samples of at
most 16 values a palette.  It has no use for the colour cache, cross-colour and the other
predictors, as its pixels have one channel.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
MAGIC, LARGEST_SIDE, LONGEST_CODE, CACHE_HASH = 0x2F, 16384, 15, 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
ALPHABETS = (280, 256, 256, 256, 40)  # green and lengths, red, blue, alpha, distances

#: The 120 nearest pixels that short distance codes name: by distance, then by |x|, right side first.
NEAR = sorted(((x, y) for y in range(8) for x in (range(1, 9) if y == 0 else range(-7, 9))), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        chunk = int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little")
        return (chunk >> (at & 7)) & ((1 << n) - 1)


class BitWriter:
    def __init__(self):
        self.value, self.size, self.parts = 0, 0, []

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def bits(self) -> np.ndarray:
        raw = np.frombuffer(self.value.to_bytes((self.size + 7) // 8, "little"), np.uint8)
        return np.unpackbits(raw, bitorder="little")[: self.size]


#: Every number of ``LONGEST_CODE`` bits turned round.
TURNED = sum(((np.arange(1 << LONGEST_CODE) >> i) & 1) << (LONGEST_CODE - 1 - i) for i in range(LONGEST_CODE)).tolist()


def canonical_codes(lengths) -> dict[int, tuple[int, int]]:
    """symbol: (bits in stream order, length) of the canonical prefix code."""
    lengths = np.asarray(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    out, code, before = {}, 0, 0
    for s, n in zip(used.tolist(), lengths[used].tolist(), strict=True):
        code <<= n - before
        out[s] = (TURNED[code] >> (LONGEST_CODE - n), n)
        code, before = code + 1, n
    return out


class PrefixCode:
    """A table from the next bits to (symbol, length)."""

    def __init__(self, lengths):
        codes = canonical_codes(lengths)
        self.single = next(iter(codes)) if len(codes) == 1 else None
        self.depth = max((n for _, n in codes.values()), default=0)
        if self.single is not None or not codes:
            self.single = self.single or 0
            self.depth = 0
            return
        self.symbols = np.zeros(1 << self.depth, np.int32)
        self.lengths = np.zeros(1 << self.depth, np.int32)
        for s, (bits, n) in codes.items():
            self.symbols[bits :: 1 << n] = s
            self.lengths[bits :: 1 << n] = n
        self.lookup = None

    def read(self, r: BitReader) -> int:
        if self.depth == 0:
            return self.single
        if self.lookup is None:
            self.lookup = list(zip(self.symbols.tolist(), self.lengths.tolist(), strict=True))
        at = r.at
        s, n = self.lookup[r.read(self.depth)]
        r.at = at + n
        return s


def read_code(r: BitReader, alphabet: int) -> PrefixCode:
    lengths = [0] * alphabet
    if r.read(1):  # simple: one or two symbols
        two, wide = r.read(1), r.read(1)
        lengths[r.read(8 if wide else 1)] = 1
        if two:
            lengths[r.read(8)] = 1
        return PrefixCode(lengths)
    own = [0] * 19
    for i in range(r.read(4) + 4):
        own[CODE_LENGTH_ORDER[i]] = r.read(3)
    code = PrefixCode(own)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    i, last = 0, 8
    while i < alphabet and left:
        left -= 1
        s = code.read(r)
        if s < 16:
            lengths[i] = s
            i += 1
            last = s or last
        else:
            times, value = (3 + r.read(2), last) if s == 16 else (3 + r.read(3), 0) if s == 17 else (11 + r.read(7), 0)
            lengths[i : i + times] = [value] * times
            i += times
    return PrefixCode(lengths[:alphabet])


def _copied(r: BitReader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.read(extra) + 1


def _distance(r: BitReader, prefix: int, width: int) -> int:
    distance = _copied(r, prefix)
    if distance > 120:
        return distance - 120
    x, y = NEAR[distance - 1]
    return max(1, x + y * width)


def read_green(r: BitReader, code: PrefixCode, distances: PrefixCode, n: int, width: int) -> np.ndarray:
    """The next n values of a channel whose other channels take no bits.  The successor of
    every bit position is looked up at once, 16 successors are composed, and only every 16th
    symbol is walked to; a back-reference has no successor, so walks end there."""
    first = r.at >> 3
    raw = np.frombuffer(r.data[first : first + n * 8 + 16] + bytes(8), np.uint8)
    words = raw[:-4].astype(np.uint32)
    for k in range(1, 4):
        words |= raw[k : len(raw) - 4 + k].astype(np.uint32) << np.uint32(8 * k)
    bits = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << code.depth) - 1)).ravel()
    size, symbols = len(bits), code.symbols[bits]
    nxt = np.minimum(np.arange(size) + np.where(symbols < 256, code.lengths[bits], 0), size - 1)
    steps = [nxt]
    for _ in range(4):
        steps.append(steps[-1][steps[-1]])
    far, at, done = steps[4], r.at & 7, 0
    out = np.empty(n, np.uint32)
    while done < n:
        walk, left = [], n - done
        for _ in range(-(-left // 16)):
            walk.append(at)
            at, before = int(far[at]), at
            if at == before:
                break
        places = np.array(walk)
        for k in (3, 2, 1, 0):
            places = np.stack([places, steps[k][places]], axis=1).ravel()
        places = places[:left]
        found = symbols[places]
        stops = np.flatnonzero(found >= 256)
        k = int(stops[0]) if len(stops) else len(places)
        out[done : done + k] = found[:k]
        done += k
        if not len(stops):
            r.at = (first << 3) + int(nxt[places[-1]])
            break
        r.at = (first << 3) + int(places[k]) + int(code.lengths[bits[places[k]]])
        length = min(_copied(r, int(found[k]) - 256), n - done)
        distance = _distance(r, distances.read(r), width)
        out[done : done + length] = np.resize(out[done - distance : done], length)
        done += length
        at = r.at - (first << 3)
    return out


def read_image(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded ARGB pixels, as 32-bit numbers."""
    cache_bits = r.read(4) if r.read(1) else 0
    cache = [0] * (1 << cache_bits)
    meta, groups, block = None, 1, 0
    if main and r.read(1):
        block = r.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        meta = (read_image(r, across, (height + (1 << block) - 1) >> block, False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    codes = [[read_code(r, n + (len(cache) if cache_bits and i == 0 else 0)) for i, n in enumerate(ALPHABETS)] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache_bits:
        green, red, blue, alpha, far = codes[0]
        if red.depth == blue.depth == alpha.depth == 0 and (green.depth or green.single < 256):
            base = (alpha.single << 24) | (red.single << 16) | blue.single
            g = read_green(r, green, far, total, width) if green.depth else np.full(total, green.single)
            return (g.astype(np.uint32) << np.uint32(8)) | np.uint32(base)
    out = [0] * total
    i = 0
    while i < total:
        if meta is None:
            group = codes[0]
        else:
            group = codes[int(meta[((i // width) >> block) * across + ((i % width) >> block)])]
        s = group[0].read(r)
        if s < 256:
            red, blue, alpha = group[1].read(r), group[2].read(r), group[3].read(r)
            new = [(alpha << 24) | (red << 16) | (s << 8) | blue]
        elif s < 280:
            length = _copied(r, s - 256)
            distance = _distance(r, group[4].read(r), width)
            new = []
            for k in range(min(length, total - i)):
                new.append(out[i - distance + k] if k < distance else new[k - distance])
        else:
            new = [cache[s - 280]]
        for v in new:
            out[i] = v
            i += 1
            if cache_bits:
                cache[((CACHE_HASH * v) & 0xFFFFFFFF) >> (32 - cache_bits)] = v
    return np.array(out, np.uint32)


def _channels(p: np.ndarray) -> np.ndarray:
    """n x 4 bytes: alpha, red, green, blue."""
    return np.stack([(p >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=1).astype(np.int64)


def _pixels(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & np.uint32(255)
    return (c[:, 0] << np.uint32(24)) | (c[:, 1] << np.uint32(16)) | (c[:, 2] << np.uint32(8)) | c[:, 3]


def predict(mode: int, left, top, corner, right) -> list[int]:
    """The predicted channels from the neighbours left, above, above left and above right."""
    half = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode in (1, 2, 3, 4):
        return [left, top, right, corner][mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode in (6, 7, 8, 9):
        return half(*[(left, corner), (left, top), (corner, top), (top, right)][mode - 6])
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        mean = half(left, top)
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]
    return [255, 0, 0, 0]


def undo_predictor(p: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    rest = _channels(p)
    across = (width + (1 << block) - 1) >> block
    mode = ((modes >> np.uint32(8)) & np.uint32(15)).astype(int)
    if set(mode.tolist()) == {2}:  # every pixel from the one above: sums along columns
        grid = rest.reshape(height, width, 4)
        grid[0, 0] += np.array([255, 0, 0, 0])
        grid[0] = np.cumsum(grid[0], axis=0)
        return _pixels(np.cumsum(grid, axis=0).reshape(-1, 4))
    out: list[list[int]] = []
    for i, d in enumerate(rest.tolist()):
        x, y = i % width, i // width
        if i == 0:
            guess = [255, 0, 0, 0]
        elif y == 0:
            guess = out[i - 1]
        elif x == 0:
            guess = out[i - width]
        else:
            guess = predict(int(mode[(y >> block) * across + (x >> block)]), out[i - 1], out[i - width], out[i - width - 1], out[i - width + 1])
        out.append([(a + b) & 255 for a, b in zip(d, guess, strict=True)])
    return _pixels(np.array(out))


def undo_cross_colour(p: np.ndarray, width: int, height: int, block: int, factors: np.ndarray) -> np.ndarray:
    c = _channels(p)
    y, x = np.divmod(np.arange(len(p)), width)
    f = _channels(factors)[(y >> block) * ((width + (1 << block) - 1) >> block) + (x >> block)]
    signed = lambda v: ((v & 255) ^ 128) - 128
    delta = lambda t, v: (signed(t) * signed(v)) >> 5
    c[:, 1] = (c[:, 1] + delta(f[:, 3], c[:, 2])) & 255
    c[:, 3] = (c[:, 3] + delta(f[:, 2], c[:, 2]) + delta(f[:, 1], c[:, 1])) & 255
    return _pixels(c)


def decode(data: bytes) -> np.ndarray:
    """Pixels (height x width, 32-bit ARGB) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    r = BitReader(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if r.read(8) != MAGIC:
        raise ValueError("bad signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    undo, full = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = r.read(3) + 2
            image = read_image(r, (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
            undo.append((kind, width, block, image))
        elif kind == PALETTE:
            size = r.read(8) + 1
            table = _pixels(np.cumsum(_channels(read_image(r, size, 1, False)), axis=0))
            bundle = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, width, bundle, table))
            width = (width + (1 << bundle) - 1) >> bundle
        else:
            undo.append((kind, width, 0, None))
    p = read_image(r, width, height, True)
    for kind, width, block, image in reversed(undo):
        if kind == PREDICTOR:
            p = undo_predictor(p, width, height, block, image)
        elif kind == CROSS_COLOUR:
            p = undo_cross_colour(p, width, height, block, image)
        elif kind == SUBTRACT_GREEN:
            c = _channels(p)
            c[:, 1] += c[:, 2]
            c[:, 3] += c[:, 2]
            p = _pixels(c)
        else:
            index = ((p >> np.uint32(8)) & np.uint32(255)).astype(int)
            if block:
                deep = 8 >> block
                spread = (index[:, None] >> (deep * np.arange(1 << block))) & ((1 << deep) - 1)
                index = spread.reshape(height, -1)[:, :width].ravel()
            known = np.concatenate([image, np.zeros(256, np.uint32)])
            p = known[index]
    return p.reshape(height, full)


def code_lengths(counts: np.ndarray, longest: int = 12) -> np.ndarray:
    """Huffman code lengths of at most ``longest`` bits; one used symbol has length 1,
    and without any there is no code."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, n = {}, len(weights)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = n
            heapq.heappush(heap, (a + b, n))
            n += 1
        depth = {n - 1: 0}
        for i in range(n - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        lengths = [depth[i] for i in range(len(weights))]
        if max(lengths) <= longest:
            out[used] = lengths
            return out
        weights = [w // 2 + 1 for w in weights]


def write_single(w: BitWriter, symbol: int) -> None:
    """A simple code of one symbol, which then takes no bits."""
    w.write(0b101, 3)
    w.write(symbol, 8)


def write_code(w: BitWriter, lengths: np.ndarray) -> None:
    """A prefix code: simple for one symbol, else its lengths under a flat code of their own."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1:
        write_single(w, int(used[0]) if len(used) else 0)
        return
    runs, i, values = [], 0, lengths.tolist()
    last = int(used[-1]) + 1
    while i < last:
        j = i
        while j < last and values[j] == values[i]:
            j += 1
        n = j - i
        if values[i] == 0 and n >= 3:
            while n >= 11:
                k = min(n, 138)
                runs.append((18, k - 11, 7))
                n -= k
            if n >= 3:
                runs.append((17, n - 3, 3))
                n = 0
        runs.extend([(values[i], 0, 0)] * n)
        i = j
    kinds = np.bincount([r[0] for r in runs], minlength=19)
    own = code_lengths(kinds, 7)
    w.write(0, 1)
    w.write(19 - 4, 4)
    for s in CODE_LENGTH_ORDER:
        w.write(int(own[s]), 3)
    extra = len(runs) - 2
    width = max(2, extra.bit_length() + (extra.bit_length() & 1))
    w.write(1, 1)
    w.write((width - 2) // 2, 3)
    w.write(extra, width)
    codes = canonical_codes(own) if (own > 0).sum() > 1 else {int(np.flatnonzero(own)[0]): (0, 0)}
    for s, more, n in runs:
        w.write(*codes[s])
        w.write(more, n)


def _prefixed(value: int) -> tuple[int, int, int]:
    """Prefix, further bits and their number of a length or a distance code."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * (extra + 1) + ((v >> extra) & 1), v & ((1 << extra) - 1), extra


#: Samples that a back-reference covers at least and at most, and how far back it reaches.
SHORTEST, LONGEST, FARTHEST = 16, 4_096, 1_000_000
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def back_references(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of copies, in order and apart.  Every eighth place is a
    source, looked up by its 8 samples; places whose next 8 agree too are extended both ways."""
    n, out = len(values), []
    if n < 3 * SHORTEST:
        return out
    at = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(values, 8)).view("<u8")[:, 0]
    sources = at[: n - 15 : 8]
    slot = ((at * SPREAD) >> np.uint64(50)).astype(np.int64)
    met = np.zeros(1 << 14, bool)
    met[slot[: n - 15 : 8]] = True
    place = np.flatnonzero(met[slot[: n - 15]])
    keys, first = np.unique(sources, return_index=True)
    which = np.minimum(np.searchsorted(keys, at[place]), len(keys) - 1)
    source = first[which] * 8
    ok = (keys[which] == at[place]) & (source < place) & (place - source <= FARTHEST)
    place, source = place[ok], source[ok]
    ok = at[source + 8] == at[place + 8]
    place, source = place[ok], source[ok]
    free = 1
    for start, back in zip(place.tolist(), source.tolist(), strict=True):
        if start < free:
            continue
        distance = start - back
        m = min(LONGEST, n - start)
        differ = np.flatnonzero(values[start : start + m] != values[back : back + m])
        end = start + (int(differ[0]) if len(differ) else m)
        while start > free and start - 1 - distance >= 0 and values[start - 1] == values[start - 1 - distance] and end - start < LONGEST:
            start -= 1
        out.append((start, end - start, distance))
        free = end
    return out


def _entropy(counts: np.ndarray) -> float:
    used = counts[counts > 0]
    return float((used * np.log2(used.sum() / used)).sum())


def _write_green(w: BitWriter, values: np.ndarray, width: int, alpha: int, copies: list[tuple[int, int, int]]) -> np.ndarray:
    """The codes of an image of one channel, and the bits of all up to its end."""
    near = {max(1, x + y * width): i for i, (x, y) in reversed(list(enumerate(NEAR, 1)))} if copies else {}
    tokens, at, literal = [], 0, np.ones(len(values), bool)
    for start, length, distance in copies:
        literal[start : start + length] = False
        tokens.append((start, _prefixed(length), _prefixed(near.get(distance, distance + 120))))
    counts = np.bincount(values[literal], minlength=280)
    far = np.zeros(40, np.int64)
    for _, length, distance in tokens:
        counts[256 + length[0]] += 1
        far[distance[0]] += 1
    lengths, far_lengths = code_lengths(counts), code_lengths(far)
    w.write(0, 1)  # no colour cache
    w.write(0, 1)  # one group of codes
    write_code(w, lengths)
    for s in (0, 0, alpha):
        write_single(w, s)
    write_code(w, far_lengths)
    code, size = np.zeros(280, np.int64), np.zeros(280, np.int64)
    table = canonical_codes(lengths)
    for s, (bits, n) in table.items() if len(table) > 1 else ():
        code[s], size[s] = bits, n
    table = canonical_codes(far_lengths)
    far_code = table if len(table) > 1 else {s: (0, 0) for s in table}
    items, sizes = [], []
    for start, length, distance in tokens:
        run = values[at:start]
        items += [code[run], [code[256 + length[0]], length[1], far_code[distance[0]][0], distance[1]]]
        sizes += [size[run], [size[256 + length[0]], length[2], far_code[distance[0]][1], distance[2]]]
        at = start + int(_copied_length(length))
    items, sizes = np.concatenate([*items, code[values[at:]]]), np.concatenate([*sizes, size[values[at:]]])
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(items)), sizes)
    body = (items[of] >> (np.arange(len(of)) - (ends - sizes)[of])) & 1
    return np.concatenate([w.bits(), body.astype(np.uint8)])


def _copied_length(coded: tuple[int, int, int]) -> int:
    prefix, more, extra = coded
    return prefix + 1 if prefix < 4 else ((2 + (prefix & 1)) << extra) + more + 1


def _write_table(w: BitWriter, colours: np.ndarray) -> None:
    """The palette: an image of one row, each entry less the one before."""
    alpha = np.zeros(len(colours), np.int64)
    alpha[0] = 255
    green = np.diff(colours.astype(np.int64), prepend=0) & 255
    w.write(0, 1)  # no colour cache
    codes = []
    for values, alphabet in ((green, 280), (alpha * 0, 256), (alpha * 0, 256), (alpha, 256)):
        lengths = code_lengths(np.bincount(values, minlength=alphabet))
        write_code(w, lengths)
        table = canonical_codes(lengths)
        codes.append(table if len(table) > 1 else {s: (0, 0) for s in table})
    write_single(w, 0)
    for g, a in zip(green.tolist(), alpha.tolist(), strict=True):
        w.write(*codes[0][g])
        w.write(*codes[3][a])


def encode(samples: np.ndarray) -> bytes:
    """A lossless WebP file with the 8-bit ``samples`` (height x width) in the green channel."""
    height, width = samples.shape
    values = samples.ravel()
    w = BitWriter()
    w.write(MAGIC, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(0, 1)
    w.write(0, 3)
    counts = np.bincount(values, minlength=256)
    colours, alpha = np.flatnonzero(counts), 255
    if len(colours) <= 16:
        w.write(1, 1)
        w.write(PALETTE, 2)
        w.write(len(colours) - 1, 8)
        _write_table(w, colours)
        bundle = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        index = np.searchsorted(colours, samples)
        index = np.pad(index, ((0, 0), (0, -width % (1 << bundle)))).reshape(height, -1, 1 << bundle)
        values = (index << ((8 >> bundle) * np.arange(1 << bundle))).sum(axis=2).astype(np.uint8).ravel()
        width, alpha = (width + (1 << bundle) - 1) >> bundle, 0
    else:
        delta = samples.copy()
        delta[1:] -= samples[:-1]
        delta[0, 1:] -= samples[0, :-1]
        if _entropy(np.bincount(delta.ravel(), minlength=256)) + 200 < _entropy(counts):
            values, alpha = delta.ravel(), 0
            w.write(1, 1)
            w.write(PREDICTOR, 2)
            w.write(7, 3)  # blocks of 512
            w.write(0, 1)  # no colour cache
            for s in (2, 0, 0, 0, 0):  # mode 2, the sample above, everywhere
                write_single(w, s)
    w.write(0, 1)  # no more transforms
    raw = np.packbits(_write_green(w, values, width, alpha, back_references(values)), bitorder="little").tobytes()
    size = len(raw)
    raw += b"\0" * (size & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(raw)) + b"WEBPVP8L" + struct.pack("<I", size) + raw


def image_shape(n: int, unit: int = 64) -> tuple[int, int]:
    """(height, width) for n samples: rows of ``unit`` or as many units as sides allow."""
    units = max(1, -(-n // unit))
    across = max(1, -(-units // LARGEST_SIDE))
    return -(-units // across), across * unit


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64, with_media: bool = False) -> DataFrame:
    """Store every whole text as a lossless image, decode the stored bytes and describe them.

    The payload is the text's UTF-8 with zero bytes up to a positive multiple of ``unit``
    (null: empty).  Payloads over 1 MB take rows of several units, the last filled with
    zeros that are cut off again.  Returns (id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature) and, if asked, the file itself.
    feature: height x width, mean and standard deviation of the decoded samples, and the
    number of different ones.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_media

    def store(batches):
        for b in batches:
            out = []
            for text in b.column(1):
                data = text.as_buffer().to_pybytes()
                size = max(unit, -(-len(data) // unit) * unit)
                height, width = image_shape(size, unit)
                samples = np.zeros(height * width, np.uint8)
                samples[: len(data)] = np.frombuffer(data, np.uint8)
                media = encode(samples.reshape(height, width))
                pixels = decode(media)
                back = ((pixels.ravel() >> np.uint32(8)) & np.uint32(255)).astype(np.uint8)[:size]
                payload = back.tobytes()
                feature = f"{height}x{width} mean={back.mean():.4f} sd={back.std():.4f} used={len(np.unique(back))}"
                out.append((len(data), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, media)[: len(types)])
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(store, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media)
