"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def near_components(texts, width, percent):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {i: shingle_set(t, width) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in texts if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def removed(texts, window):
    """doc_id -> flags of the bytes covered by strings that start anywhere else too."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(d[p : p + window] for d in data.values() for p in range(len(d) - window + 1))
    out = {}
    for i, d in data.items():
        cover, until = bytearray(len(d)), 0
        for p in range(len(d)):
            if p + window <= len(d) and seen[d[p : p + window]] > 1:
                until = p + window
            cover[p] = p < until
        out[i] = cover
    return out


def removal_row(text, cover):
    d = (text or "").encode()
    runs = len(re.findall(b"\x01+", bytes(cover)))
    return len(d), sum(cover), runs, hashlib.sha256(bytes(b for b, c in zip(d, cover, strict=True) if not c)).hexdigest()


def crc(text):
    return zlib.crc32((text or "").encode())
