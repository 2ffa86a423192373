"""Token counts with a byte-pair vocabulary as ranks.

A pattern cuts a text into pieces; within a piece, the pair of neighbours with the lowest rank is merged until none has one.
Pairs wait in a heap and parts are a linked list, so long pieces take n log n steps. Pieces recur, so each worker remembers
their counts. The ranks are read where the query is made and travel with it; executors need no file."""

from __future__ import annotations

import base64
import functools
import heapq
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pattern of GPT-2's byte-level vocabulary, which cuts texts into pieces.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers, and the longest of them.
REMEMBERED, LONGEST, SHORT = 1 << 18, 64, 48


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """Of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


NONE = 1 << 62


def merged_short(piece: bytes, known: dict[bytes, int]) -> int:
    """`merged` for pieces of few bytes: the least rank is looked for in a list."""
    rank = known.get
    cuts = list(range(len(piece) + 1))
    pairs = [rank(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < NONE:
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = rank(piece[cuts[i] : cuts[i + 2]], NONE)
        if i:
            pairs[i - 1] = rank(piece[cuts[i - 1] : cuts[i + 1]], NONE)
    return len(cuts) - 1


def merged(piece: bytes, known: dict[bytes, int]) -> int:
    """Parts of a piece after all merges."""
    if piece in known:
        return 1
    if len(piece) <= SHORT:
        return merged_short(piece, known)
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place: where the next and the last one begin
    live = bytearray(b"\1") * n
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        middle = after[at]
        if middle < n and (rank := known.get(piece[at : after[middle]])) is not None:
            heapq.heappush(heap, (rank, at, after[middle]))

    for i in range(n - 1):
        offer(i)
    parts = n
    while heap:
        _, at, end = heapq.heappop(heap)
        if not live[at] or (middle := after[at]) >= end or after[middle] != end:  # one of the two has grown or gone since
            continue
        live[middle] = 0
        after[at] = end
        if end < n:
            before[end] = at
        parts -= 1
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    return parts


class TokenCounter:
    """Counts texts' tokens; made once in each worker."""

    def __init__(self, known: dict[bytes, int], pattern: str = PIECES):
        self.known, self.pieces, self.seen = known, regex.compile(pattern), {}

    def piece(self, piece: str) -> int:
        if len(piece) > LONGEST:
            return merged(piece.encode(), self.known)
        if (n := self.seen.get(piece)) is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            n = self.seen[piece] = merged(piece.encode(), self.known)
        return n

    def count(self, text: str) -> int:
        return sum(self.piece(p) * n for p, n in Counter(self.pieces.findall(text)).items())


def token_count(text: Column, path: str, pattern: str = PIECES) -> Column:
    """Tokens of a text; null for null. `path` is a file of base64 tokens and ranks."""
    known = ranks(path)

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = TokenCounter(known, pattern).count
        for texts in batches:
            yield pd.Series([None if t is None else count(t) for t in texts], dtype="Int32")

    return run(text)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up: a count without a vocabulary."""
    return F.ceil(F.length(text) / 4).cast("int")
