"""Polynomial hashes over bytes and words, in numpy: prefix sums modulo 2**64, windows, minimisers, packed blobs.

The hash of data[a:b] is (S[b] - S[a]) * BASE**-a with S the prefix sums of salted bytes times powers of the odd BASE.
Equal hashes are candidates only; callers that need exact results verify bytes.
"""

from __future__ import annotations

import numpy as np
import zstandard

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = 0x20
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SALTS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), kept and grown as needed."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        known[0] = 1
        _powers[base] = known = np.cumprod(known, dtype=np.uint64)
    return known[:n]


#: Of each of two streams: a random word for each byte at each of the first places of a word.
PLACES = 32
TABLES = [mix(np.arange(1, (PLACES << 8) + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(s << 32)) for s in (1, 2)]


def hash_words(flat: np.ndarray, start: np.ndarray, lengths: np.ndarray, stream: int = 0) -> np.ndarray:
    """Hashes of words that follow one another in `flat`, each with one byte after it, by tabulation: the sum of random
    words for byte and place. Unlike a polynomial modulo 2**64, it has no words that collide whatever its parameters."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    place = np.arange(len(flat), dtype=np.int32) - np.repeat(start.astype(np.int32), lengths + 1)
    index = (place << 8) | flat
    far = np.flatnonzero(place >= PLACES)
    index[far] = 0
    values = TABLES[stream][index]
    if len(far):
        values[far] = mix(((place[far].astype(np.uint64) << np.uint64(8)) | flat[far].astype(np.uint64)) * np.uint64(BASE) + np.uint64(stream + 1 << 48))
    return mix(np.add.reduceat(values, start))


class Prefix:
    """Prefix hashes of a sequence of 64-bit words (or salted bytes)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        if values.dtype == np.uint8:
            values = SALTS[values]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def windows(self, width: int) -> np.ndarray:
        """Of every window of this width, by its start."""
        n = max(0, len(self.sums) - width)
        return (self.sums[width : width + n] - self.sums[:n]) * self.inverse[:n]


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    span = 1
    while span * 2 <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[:n], a[width - span : width - span + n]) if span < width else a[:n]


K_TRIPLE = mix(np.array([11, 12], dtype=np.uint64))
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[SPACE, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(lengths) - lengths, lengths)


def runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of n + 1 items, `same` telling of the last n whether each continues its run."""
    cut = np.flatnonzero(~same) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(same) + 1]))


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed string; `unpack` with the arrays' types gives them back.

    Of an array the first bytes of all numbers come first, then the second ones: small numbers leave runs of zeros."""
    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p).view(np.uint8).reshape(-1, p.dtype.itemsize).T.tobytes() for p in parts]
    head = np.array([len(r) for r in raw], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(raw))


def unpack(blob: bytes, *kinds: type | None) -> list:
    """Kinds are numpy types, or None for a byte string."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, dtype=np.int64, count=len(kinds))
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        part = raw[at : at + size]
        if kind is None:
            out.append(part)
        else:
            wide = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(np.frombuffer(part, dtype=np.uint8).reshape(wide, -1).T).view(kind).reshape(-1))
        at += size
    return out
