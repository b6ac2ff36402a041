"""Token counts by byte-pair merging, with the ranks of a caller's vocabulary file.

A text is cut into pieces by a pattern; in each piece the neighbouring parts
whose join has the least rank are joined, the leftmost on a tie, until no join
has a rank. A heap of joins keeps a long piece from costing its square.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Contractions, words and numbers with the space before them, marks, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Tokens of a vocabulary, at most: it is broadcast.
MOST_TOKENS = 1_000_000
#: Pieces whose counts a worker keeps.
KEPT = 1 << 16


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base64 and its rank a line."""
    lines = spark.read.text(path).where(F.trim("value") != "").limit(MOST_TOKENS + 1).collect()
    if len(lines) > MOST_TOKENS:
        raise ValueError(f"{path} has over {MOST_TOKENS} tokens")
    pairs = (r.value.split() for r in lines)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece."""
    n = len(piece)
    if piece in ranks or n < 2:
        return [piece] if n else []
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = [False] * (n + 1)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or after[j] != end:
            continue  # one of the two parts has changed since
        gone[j], after[i] = True, end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    return [piece[i : after[i]] for i in range(n) if not gone[i]]


class Counter:
    """Counts the tokens of texts; pieces that were counted before are looked up. What it has kept does not travel."""

    def __init__(self, ranks, pattern: re.Pattern):
        self.ranks, self.pattern, self.kept = ranks, pattern, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": None}

    def __call__(self, text: str | None) -> int:
        if self.kept is None:
            ranks = self.ranks.value
            self.kept = lru_cache(KEPT)(lambda piece: len(merged(piece.encode(), ranks)))
        return sum(self.kept(m.group()) for m in self.pattern.finditer(text or ""))


def counter(spark: SparkSession, ranks: dict[bytes, int], pattern: str | re.Pattern = PATTERN) -> Callable[[str], int]:
    """A token counter for ``chunk.token_chunks``: the ranks are broadcast once, not sent with every task."""
    return Counter(spark.sparkContext.broadcast(ranks), re.compile(pattern) if isinstance(pattern, str) else pattern)
