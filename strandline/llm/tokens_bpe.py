"""Token counts by heap-and-linked-list byte-pair merging.

No identifiers are made: a text's count is its number of initial symbols less the
merges that happen, plus the extra bytes of symbols that fall back to bytes.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Distinct chunks whose counts a worker remembers before it starts anew.
REMEMBERED = 800_000


class Vocabulary:
    """Ranks of the pieces of a sentencepiece BPE model (best merge: lowest rank)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap:
            raise ValueError("a BPE model without a character map is needed")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == 1}
        #: Neighbouring characters that some piece holds; no merge ever joins others.
        self.joined = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        inner = [x for x in self.joined if x[1] == SPACE and x[0] != SPACE]
        self.chunks = None if inner else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.chunk_counts: dict[str, int] = {}
        self.run_counts: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of a whole text, in chunks that begin with their spaces."""
        if not text:
            return 0
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        known = self.chunk_counts
        if len(known) > REMEMBERED:
            known.clear()
        total = 0
        for chunk in self.chunks.findall(text) if self.chunks else [text]:
            n = known.get(chunk)
            if n is None:
                n = self.count_chunk(chunk)
                if len(chunk) <= 64:
                    known[chunk] = n
            total += n
        return total

    def count_chunk(self, chunk: str) -> int:
        """Sum over the runs between neighbours that never join."""
        joined, known, total, start = self.joined, self.run_counts, 0, 0
        if len(known) > REMEMBERED:
            known.clear()
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in joined]
        for end in [*cuts, len(chunk)]:
            run = chunk[start:end]
            n = known.get(run)
            if n is None:
                n = count_merged(run, self.rank)
                if len(run) <= 64:
                    known[run] = n
            total += n
            start = end
        return total


def count_merged(text: str, rank: dict[str, float]) -> int:
    """Tokens of ``text``: pop the best adjacent pair (ties: the left one) from a
    heap, join it in a linked list of symbols, push its new neighbours, repeat."""
    symbols = list(text)
    n = len(symbols)
    get, push, pop = rank.get, heapq.heappush, heapq.heappop
    heap = [(r, i, i + 1, p) for i, p in enumerate(map(str.__add__, text, text[1:])) if (r := get(p)) is not None]
    if heap:
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            _, i, j, pair = pop(heap)
            left, right = symbols[i], symbols[j]
            # stale: one side is gone or has grown since
            if left is None or right is None or len(left) + len(right) != len(pair) or after[i] != j:
                continue
            symbols[i], symbols[j] = pair, None
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(p := pair + symbols[k])) is not None:
                    push(heap, (r, i, k, p))
            if (h := before[i]) >= 0 and (r := get(p := symbols[h] + pair)) is not None:
                push(heap, (r, h, i, p))
    else:
        merges = 0
    fallback = sum(len(s.encode()) - 1 for s in symbols if s is not None and s not in rank)
    return n - merges + fallback


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row.

    A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows are counted each.
    Texts of any length are counted whole.  ``model`` must be readable on executors.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches):
        v = vocabulary(model)
        for b in batches:
            n = [v.count(t.as_py()) for t in b.column(1)]
            size = pa.compute.binary_length(b.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
