"""Off-target patterns: counts of mismatches, gaps, insertions and deletions in ranges of
an alignment, combined left to right by AND (``,``) and OR (``|``), parsed into a Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"m": "m", "i": "i", "d": "d", "g": "id"}


def position_range(text: str, length: int) -> tuple[int, int, bool]:
    """1-based inclusive positions, and whether they count from the 3' end: ``5`` is the
    first five, ``5-`` from the fifth on, ``2-5``; ``-5`` is the last five, ``-5-`` up to the
    fifth from the end, ``-2--5`` both from the end; empty: all.  Zero, and a range of both
    kinds, raise ValueError."""
    if not text:
        return 1, length, False
    m = re.fullmatch(r"(-?\d+)(-(-?\d+)?)?", text)
    if not m or int(m[1]) == 0 or (m[3] and int(m[3]) == 0):
        raise ValueError(f"bad range {text!r}")
    first, back = int(m[1]), m[1].startswith("-")
    if m[3]:
        other = int(m[3])
        if (other < 0) != back:
            raise ValueError(f"the ends of {text!r} must count from the same side")
        lo, hi = sorted((first, other) if not back else (length + first + 1, length + other + 1))
        return max(lo, 1), hi, back
    if not back:
        return (1, first, False) if not m[2] else (first, length, False)
    at = length + first + 1
    return (max(at, 1), length, True) if not m[2] else (1, at, True)


def off_target(pattern: str, ops: Column, length: int, back_ops: Column | None = None) -> Column:
    """True where the alignment satisfies ``pattern``.  ``ops`` is an array of strings,
    one a query position: ``.`` match, ``m``, ``i``, and ``d`` for each base missing there;
    ``back_ops`` is the same with missing bases at the position before them, for ranges that
    count from the 3' end (default: ``ops``)."""
    tokens = re.findall(r"\d+[mgid]+-?\d*-?-?\d*|[(),|]", pattern.replace(" ", ""))
    if "".join(tokens) != pattern.replace(" ", ""):
        raise ValueError(f"bad pattern {pattern!r}")

    def unit(text: str) -> Column:
        most, kinds, where = re.fullmatch(r"(\d+)([mgid]+)(.*)", text).groups()
        lo, hi, back = position_range(where, length)
        letters = "".join(sorted({c for k in kinds for c in KINDS[k]}))
        if hi < lo:
            return F.lit(True)
        part = F.array_join(F.slice(back_ops if back and back_ops is not None else ops, lo, hi - lo + 1), "")
        others = part
        for c in letters:
            others = F.replace(others, F.lit(c), F.lit(""))
        return F.length(part) - F.length(others) <= int(most)

    def group(i: int) -> tuple[Column, int]:
        value, how = None, None
        while i < len(tokens) and tokens[i] != ")":
            if tokens[i] in ",|":
                how, i = tokens[i], i + 1
                continue
            if tokens[i] == "(":
                new, i = group(i + 1)
                i += 1
            else:
                new, i = unit(tokens[i]), i + 1
            value = new if value is None else (value & new) if how == "," else (value | new)
        return value, i

    return group(0)[0]
