"""Every predictor, cross-colour and several groups of prefix codes, written here and read back."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from strandline.llm import webp as W


def average(a, b):
    return (a + b) // 2


def guess(mode, left, top, corner, right):
    clamp = lambda v: np.clip(v, 0, 255)
    if mode == 11:
        plane = left + top - corner
        return left if np.abs(plane - left).sum() < np.abs(plane - top).sum() else top
    if mode == 13:
        mean = average(left, top)
        return clamp(mean + np.trunc((mean - corner) / 2).astype(int))
    return {
        0: np.array([255, 0, 0, 0]), 1: left, 2: top, 3: right, 4: corner, 5: average(average(left, right), top), 6: average(left, corner),
        7: average(left, top), 8: average(corner, top), 9: average(top, right), 10: average(average(left, corner), average(top, right)), 12: clamp(left + top - corner),
    }[mode]


def residuals(pixels, modes, block):
    """pixels: height x width x 4 (alpha, red, green, blue); modes: one a block."""
    height, width = pixels.shape[:2]
    flat, out = pixels.reshape(-1, 4), []
    for i, p in enumerate(flat):
        x, y = i % width, i // width
        if i == 0:
            g = np.array([255, 0, 0, 0])
        elif y == 0:
            g = flat[i - 1]
        elif x == 0:
            g = flat[i - width]
        else:
            g = guess(int(modes[y >> block, x >> block]), flat[i - 1], flat[i - width], flat[i - width - 1], flat[i - width + 1])
        out.append((p - g) % 256)
    return np.array(out).reshape(pixels.shape)


def signed(v):
    return (np.asarray(v) + 128) % 256 - 128


def crossed(pixels, factors, block):
    """factors: (green to red, green to blue, red to blue) of each block."""
    out = pixels.copy()
    for y in range(pixels.shape[0]):
        for x in range(pixels.shape[1]):
            g2r, g2b, r2b = factors[y >> block, x >> block]
            _, r, g, b = pixels[y, x]
            out[y, x, 1] = (r - ((signed(g2r) * signed(g)) >> 5)) % 256
            out[y, x, 3] = (b - ((signed(g2b) * signed(g)) >> 5) - ((signed(r2b) * signed(r)) >> 5)) % 256
    return out


def write_pixels(w, pixels, main=False, group=None, block=2):
    """Literals only; ``group`` gives each block of the main image a group of codes."""
    height, width = pixels.shape[:2]
    w.write(0, 1)  # no colour cache
    of = np.zeros((height, width), int)
    if main and group is not None:
        w.write(1, 1)
        w.write(block - 2, 3)
        meta = np.zeros((*group.shape, 4), int)
        meta[..., 2] = group
        write_pixels(w, meta)
        of = np.repeat(np.repeat(group, 1 << block, 0), 1 << block, 1)[:height, :width]
    elif main:
        w.write(0, 1)
    tables = []
    for k in range(of.max() + 1):
        own = []
        for channel, alphabet in ((2, 280), (1, 256), (3, 256), (0, 256)):
            lengths = W.code_lengths(np.bincount(pixels[of == k][:, channel], minlength=alphabet))
            W.write_code(w, lengths)
            table = W.canonical_codes(lengths)
            own.append(table if len(table) > 1 else {s: (0, 0) for s in table})
        W.write_single(w, 0)
        tables.append(own)
    for p, k in zip(pixels.reshape(-1, 4).tolist(), of.ravel().tolist(), strict=True):
        for table, channel in zip(tables[k], (2, 1, 3, 0), strict=True):
            w.write(*table[p[channel]])


def start(height, width):
    w = W.BitWriter()
    for value, n in ((W.MAGIC, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.write(value, n)
    return w


def file_of(w):
    raw = np.packbits(w.bits(), bitorder="little").tobytes()
    return b"RIFF" + struct.pack("<I", 12 + len(raw) + (len(raw) & 1)) + b"WEBPVP8L" + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) & 1)


def channels(decoded):
    return np.stack([(decoded >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(int)


def image(seed, height=11, width=13):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 4))


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    pixels, block = image(mode), 2
    modes = np.full((3, 4), mode)
    w = start(*pixels.shape[:2])
    w.write(1, 1)
    w.write(W.PREDICTOR, 2)
    w.write(block - 2, 3)
    table = np.zeros((3, 4, 4), int)
    table[..., 2] = modes
    write_pixels(w, table)
    w.write(0, 1)
    write_pixels(w, residuals(pixels, modes, block), main=True)
    assert (channels(W.decode(file_of(w))) == pixels).all()


def test_predictors_cross_colour_and_groups_together():
    rng, pixels, block = np.random.default_rng(3), image(99), 2
    factors, modes, group = rng.integers(0, 256, (3, 4, 3)), rng.integers(0, 14, (3, 4)), rng.integers(0, 3, (3, 4))
    group[0, :3] = 0, 1, 2
    w = start(*pixels.shape[:2])
    for kind, table in ((W.CROSS_COLOUR, np.dstack([np.full((3, 4), 255), factors[..., 2], factors[..., 1], factors[..., 0]])), (W.PREDICTOR, np.dstack([np.zeros((3, 4), int), np.zeros((3, 4), int), modes, np.zeros((3, 4), int)]))):
        w.write(1, 1)
        w.write(kind, 2)
        w.write(block - 2, 3)
        write_pixels(w, table)
    w.write(0, 1)
    write_pixels(w, residuals(crossed(pixels, factors, block), modes, block), main=True, group=group, block=block)
    assert (channels(W.decode(file_of(w))) == pixels).all()


@pytest.mark.parametrize("text", ["ab " * 5_000, "x" * 3_000, "0101" * 40 + "2", "the same line of words\n" * 30 + "and another", "q", "", bytes(range(33, 120)).decode() * 90])
def test_copies_and_palettes_come_back(text):
    data = text.encode()
    size = max(64, -(-len(data) // 64) * 64)
    samples = np.frombuffer(data.ljust(size, b"\0"), np.uint8).reshape(W.image_shape(size))
    stored = W.encode(samples)
    assert (channels(W.decode(stored))[..., 2] == samples).all()
    assert len(stored) < 200 + 0.2 * size


def test_copies_stand_apart_and_agree():
    rng = np.random.default_rng(8)
    parts = [rng.integers(0, 99, 40, np.uint8) for _ in range(6)]
    values = np.concatenate([parts[i] for i in rng.integers(0, 6, 80)])
    free = 1
    for at, length, distance in W.back_references(values):
        assert at >= free and W.SHORTEST <= length <= W.LONGEST and 0 < distance <= at
        assert all(values[k] == values[k - distance] for k in range(at, at + length))
        free = at + length
    assert free > 3_000
