"""Hashes of all windows of a fixed length, for whole batches of texts."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 19)
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of each number over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """A batch of texts as code points, and the hash of any window of it."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ahead, self.back = _power(len(self.codes) + 1)
        terms = mix(self.codes.astype(np.uint64) + np.uint64(1)) * ahead[: len(self.codes)]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    def hashes(self, length: int) -> np.ndarray:
        """Hashes of the windows at all places, texts' ends ignored."""
        n = max(0, len(self.codes) - length + 1)
        return mix((self.sums[length : length + n] - self.sums[:n]) * self.back[:n])

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the windows at some places."""
        return mix((self.sums[places + length] - self.sums[places]) * self.back[places])

    def inside(self, length: int) -> np.ndarray:
        """Which windows end within their text."""
        n = max(0, len(self.codes) - length + 1)
        ends = self.starts + self.lengths
        mark = np.zeros(len(self.codes) + 1, np.int32)  # over the last length - 1 places of every text
        np.add.at(mark, np.maximum(ends - length + 1, self.starts), 1)
        np.add.at(mark, ends, -1)
        return np.cumsum(mark)[:n] == 0

    def text_of(self, places: np.ndarray) -> np.ndarray:
        """Number of the text that holds each place."""
        return np.searchsorted(self.starts + self.lengths, places, side="right")


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window of ``width`` values."""
    n = len(x)
    if n < width:
        return x[:0]
    pad = -n % width
    top = np.iinfo(x.dtype).max
    y = np.concatenate((x, np.full(pad, top, x.dtype))).reshape(-1, width)
    head = np.minimum.accumulate(y, axis=1).ravel()
    tail = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def anchors(windows: Windows, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each stretch of ``width`` consecutive places: the place whose window of ``gram`` characters has the
    smallest hash there (the first of equal ones); and the hashes at all places.

    Equal stretches of two texts, of ``gram + width - 1`` characters, have their anchor at the same place of them.
    Stretches that reach over the end of a text have an anchor too, which means nothing.
    """
    h = windows.hashes(gram)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    return (sliding_min(key, width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), h
