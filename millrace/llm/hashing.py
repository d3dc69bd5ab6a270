"""Vectorised hashes of words and word runs, over many texts at once.

A run's hash is a polynomial over its words' hashes in 64-bit arithmetic with odd bases, so that any run's value
comes from two prefix sums; the finaliser spreads it over all bits. Hashes depend on content alone.
"""

from __future__ import annotations

import numpy as np

_BYTE, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SEGMENT = 1_000_000
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, from 0 to n."""
    held = _POWERS.get(int(base))
    if held is None or len(held[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        out = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        held = _POWERS[int(base)] = (out[0], out[1])
    return held


class Runs:
    """Words of many texts end to end; ``first[d]`` is the place of text d's first word, ``first[-1]`` the number of words."""

    def __init__(self, words: list[list[bytes]]):
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        n = int(self.first[-1])
        joined = b" ".join([b" ".join(w) for w in words if w]) + b" " if n else b""
        data = np.frombuffer(joined, dtype=np.uint8)
        ends = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], ends[:-1] + 1]) if n else ends
        self.words = np.empty(n, dtype=np.uint64)
        # segments of whole words bound the memory of the byte sums, however long a text is
        cuts = np.unique(np.searchsorted(ends, np.arange(_SEGMENT, len(data) + _SEGMENT, _SEGMENT)).clip(max=n)) if n else []
        for a, b in zip([0, *cuts], [*cuts, n]):
            if b > a:
                low = starts[a]
                part, first, last = data[low : ends[b - 1]], starts[a:b] - low, ends[a:b] - low
                up, down = _powers(_BYTE, len(part))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)])
                self.words[a:b] = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * _WORD)
        self.up, self.down = _powers(_WORD, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * self.up[:n], dtype=np.uint64)])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the runs of k words from every place, also across texts."""
        n = max(0, len(self.words) - k + 1)
        return mix((self.sums[k : k + n] - self.sums[:n]) * self.down[:n])

    def spans(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hashes of runs of any length; the length counts too."""
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + length.astype(np.uint64))

    def starts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a run of k words stays within its text, and the texts' numbers."""
        room = np.maximum(np.diff(self.first) - k + 1, 0)
        text = np.repeat(np.arange(len(room)), room)
        within = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(room)[:-1]]), room)
        return self.first[text] + within, text


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[: len(x) - reach], x[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
