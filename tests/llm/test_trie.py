"""The prefix trie: against the SQL, a plain version, hot and awkward conversations."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from strandline.llm import prefix_trie as pt
from strandline.llm.queries import ORACLES, QUERIES
from tests.conftest import duck_rows, rows_of

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, place string, x string, nth string, row_before string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode(), role or "", text or ""))
    own = {c: [t[4:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c > 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    nodes = {}
    for c, q in built.items():
        for d in range(len(q) + 1):
            nodes.setdefault(q[:d], []).append(c)
    out = {}
    for key in sorted(nodes, key=len, reverse=True):
        members = nodes[key]
        kids = [k for k in nodes if len(k) == len(key) + 1 and k[: len(key)] == key]
        leaves = sum(out[k][5] for k in kids) if kids else 1
        saved = sum(out[k][6] for k in kids) + ((len(members) - 1) * len(key[-1][1]) if key else 0)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(key))))
        out[key] = (min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in pt.prefix_trie(df).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3)


def test_equals_the_sql(spark, sf_dir):
    got = QUERIES["op11_prefix_trie"](spark, sf_dir)
    columns, expected = duck_rows(ORACLES["op11_prefix_trie"], sf_dir)
    assert sorted(got.columns) == columns and expected
    assert rows_of(got.columns, got.collect()) == expected


def test_shared_prefixes_of_many_depths(spark):
    rng = random.Random(3)
    rows = []
    for c in list(range(0, 330, 3)) + [100, 200, 1000, 1007, 1300]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "cccé\U0001f600"])))
    assert found(frame(spark, rows)) == plain(rows)


@pytest.mark.parametrize("chunk", [40, 1 << 16])
def test_hot_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(pt, "CHUNK_BYTES", chunk)
    long = [(100, t, "user", f"turn {t}") for t in range(700)]
    copies = [(c, t, "user", f"same {t}") for c in range(2000, 2300) for t in range(3)]
    assert found(frame(spark, long + copies)) == plain(long + copies)


def test_awkward_rows(spark):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, None, "user", ""), (5, 2, "user", "x"), (5, 2, "user", "x"), (7, 0, "user", "no base"), (300, 0, None, "base"), (301, 1, "", "base"), (301, 0, "user", "y" * 100_000)]
    rows += [(c, t, "user", "tie") for c in (-120, -100, 1 << 60) for t in (0, 0, 1)]
    assert found(frame(spark, rows)) == plain([r for r in rows])
    assert found(frame(spark, rows[:1])) == [] == found(spark.createDataFrame([], SCHEMA))
