"""Vectorised hashing of byte strings, shared by operators on whole texts.

A buffer's running polynomial sums give the hash of any of its spans in constant time: (sum(end) - sum(start)) * base**-start, all modulo
2**64, over random 64-bit codes of the bytes; the length is mixed in. Texts are hashed a few hundred KB at a time, long ones alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_RNG = np.random.default_rng(20_24)
_CODES = _RNG.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: The separators of words in a byte string: white space of ASCII.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 256 << 10


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    held = _POWERS.get(which)
    if held is None or len(held[0]) < n:
        size, base = max(n, CHUNK + 1), _BASES[which]
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        held = np.cumprod(up), np.cumprod(down)
        if n <= 8 * CHUNK:
            _POWERS[which] = held
    return held


class Spans:
    """Hashes of spans of one buffer."""

    def __init__(self, buf: np.ndarray, which: int = 0):
        self.up, self.down = _powers(len(buf) + 1, which)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_CODES[which][buf] * self.up[: len(buf)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def chunks(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes together."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts, a line feed after each, as one buffer, and where each begins."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buf, starts


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that ends in a separator."""
    inside = ~SPACE[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    return edge[0::2], edge[1::2]


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the A-Z-lower-cased words of some texts together, and the first word of each text (and the end)."""
    buf, at = joined(texts)
    buf = LOWER[buf]
    start, end = words(buf)
    return Spans(buf).hash(start, end), np.searchsorted(start, at)


def shingles(texts: Sequence[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its shingles; a text of fewer words is one shingle, one without words has none."""
    step = [np.uint64(int(x) | 1) for x in np.random.default_rng(5).integers(1, 2**63, size)]
    for a, b in chunks(texts):
        h, first = word_hashes(texts[a:b])
        n = max(0, len(h) - size + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(size):
            rolled += h[k : k + n] * step[k]
        rolled = mix(rolled)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= size:
                yield np.unique(rolled[lo : hi - size + 1])
            elif hi > lo:
                short = np.array([hi - lo], np.uint64)
                for k in range(lo, hi):
                    short = mix(short * step[0] + h[k : k + 1])
                yield short
            else:
                yield np.zeros(0, np.uint64)
