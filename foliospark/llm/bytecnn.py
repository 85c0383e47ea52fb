"""Byte convolutional network for short texts: filters of several widths, max pooling, softmax; trained in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes of a window, widths of the filters, filters of each width.
WINDOW, WIDTHS, FILTERS = 64, (2, 4, 6), 16


def _byte_classes() -> np.ndarray:
    """Class of each byte: 0 pads, letters without case, one class each for digits, blanks and other ASCII, then the rest."""
    out = np.full(256, 3, np.int32)
    out[[9, 10, 12, 13, 32]] = 2
    out[48:58] = 1
    out[65:91] = out[97:123] = np.arange(4, 30)
    out[128:] = np.arange(30, 158)
    return out


CLASSES = _byte_classes()
N_CLASSES = 158


class ByteCnn:
    """Network over windows of byte classes."""

    def __init__(self, n_out: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.tables = [rng.normal(0, 0.3 / w, (w, N_CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        for t in self.tables:
            t[:, 0] = 0
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.head = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), n_out)).astype(np.float32)
        self.shift = np.zeros(n_out, np.float32)
        self._pairs: list[list[np.ndarray]] | None = None

    def _pair_tables(self) -> list[list[np.ndarray]]:
        """Each filter as a sum of tables over pairs of bytes, two places apart."""
        if self._pairs is None:
            self._pairs = [
                [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(-1, FILTERS) for j in range(0, len(t), 2)] for t in self.tables
            ]
        return self._pairs

    def log_probabilities(self, windows: np.ndarray, at_once: int = 512) -> np.ndarray:
        """Log of the softmax for each row of byte classes."""
        pairs = self._pair_tables()
        pooled = np.empty((len(windows), FILTERS * len(WIDTHS)), np.float32)
        for a in range(0, len(windows), at_once):
            part = windows[a : a + at_once].astype(np.int32)
            codes = part[:, :-1] * N_CLASSES + part[:, 1:]
            for k, tables in enumerate(pairs):
                n = WINDOW - 2 * len(tables) + 1
                z = tables[0].take(codes[:, :n], axis=0)
                for j in range(1, len(tables)):
                    z += tables[j].take(codes[:, 2 * j : 2 * j + n], axis=0)
                pooled[a : a + at_once, k * FILTERS : (k + 1) * FILTERS] = z.max(axis=1)
        return self._softmax(np.maximum(pooled + self.bias, 0))

    def _softmax(self, hidden: np.ndarray) -> np.ndarray:
        logits = hidden @ self.head + self.shift
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 4) -> ByteCnn:
        """Train by Adam on cross entropy; the pooled place of each filter gets the gradient."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.head, self.shift]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                x, y, rows = windows[own].astype(np.int32), labels[own], np.arange(len(own))
                pooled, places = [], []
                for t in self.tables:
                    n = WINDOW - len(t) + 1
                    z = sum(t[j].take(x[:, j : j + n], axis=0) for j in range(len(t)))
                    best = z.argmax(1)
                    places.append(best)
                    pooled.append(np.take_along_axis(z, best[:, None, :], 1)[:, 0])
                raw = np.concatenate(pooled, 1) + self.bias
                hidden = np.maximum(raw, 0)
                error = np.exp(self._softmax(hidden))
                error[rows, y] -= 1
                error /= len(own)
                back = (error @ self.head.T) * (raw > 0)
                grads = []
                for k, t in enumerate(self.tables):
                    g = np.zeros_like(t)
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(len(t)):
                        hit = x[rows[:, None], places[k] + j] * FILTERS + np.arange(FILTERS)
                        g[j] = np.bincount(hit.ravel(), part.ravel(), N_CLASSES * FILTERS).reshape(N_CLASSES, FILTERS)
                    g[:, 0] = 0
                    grads.append(g)
                grads += [back.sum(0), hidden.T @ error, error.sum(0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self._pairs = None
        return self
