"""A byte convolutional network for classes of text, trained in numpy.

Bytes are embedded, filters of widths 2, 3 and 4 slide over a window of 256 bytes, each filter's greatest
response goes through a rectifier, and a linear layer with softmax gives the classes. A text is cut into
windows that cover all of it; its class probabilities are the windows' means, weighted by their bytes.
A response is a sum of one table row per byte (pair), so that prediction reads tables made once.
"""

from __future__ import annotations

import numpy as np

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: What windows are filled up with; no byte of UTF-8 text.
FILL = 0xFF


def windows_of(data: np.ndarray) -> np.ndarray:
    """All of ``data`` in rows of WINDOW bytes, the last filled up."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, FILL, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


class ByteCNN:
    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)
        self._tables: list | None = None

    # Training

    def _parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def fit(self, rows: np.ndarray, labels: np.ndarray, epochs: int = 6, least_steps: int = 600, batch: int = 64, rate: float = 0.004, seed: int = 11) -> None:
        """Adam on the mean cross entropy of the windows ``rows`` with class numbers ``labels``, classes weighted alike; few rows are gone over
        more often, for ``least_steps`` in all."""
        rng = np.random.default_rng(seed)
        share = np.bincount(labels, minlength=len(self.classes)).astype(np.float32)
        weight = (len(labels) / np.maximum(share, 1) / max(1, (share > 0).sum()))[labels]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in self._parameters()]
        t = 0
        for _ in range(max(epochs, -(-least_steps * batch // max(1, len(rows))))):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                t += 1
                for p, g, (m, v) in zip(self._parameters(), self._gradients(rows[pick], labels[pick], weight[pick]), state, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self._tables = None

    def _gradients(self, rows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n, arange = len(rows), np.arange(len(rows))
        x = self.embed[rows]
        pooled, best = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            cols = np.lib.stride_tricks.sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * EMBED)
            response = cols @ f
            top = response.argmax(axis=1)
            best.append(top)
            pooled.append(np.take_along_axis(response, top[:, None, :], 1)[:, 0] + b)
        z = np.concatenate(pooled, axis=1)
        hidden = np.maximum(z, 0)
        p = _softmax(hidden @ self.out + self.out_bias)
        p[arange, labels] -= 1
        p *= (weight / n)[:, None]
        back = (p @ self.out.T) * (z > 0)
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], []
        for k, (w, f, top) in enumerate(zip(WIDTHS, self.filters, best, strict=True)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            d_f = np.zeros((w, EMBED, FILTERS), np.float32)
            shaped = f.reshape(w, EMBED, FILTERS)
            for j in range(w):
                taken = rows[arange[:, None], top + j]
                d_f[j] = np.einsum("nfe,nf->ef", self.embed[taken], g)
                np.add.at(d_embed, taken.ravel(), (g[:, :, None] * shaped[j].T[None]).reshape(-1, EMBED))
            d_filters.append(d_f.reshape(w * EMBED, FILTERS))
            d_bias.append(g.sum(axis=0))
        return [d_embed, *d_filters, *d_bias, hidden.T @ p, p.sum(axis=0)]

    # Prediction

    def _prepared(self) -> list:
        """Per width: (offset, table, pairs?) whose rows' sum is the response at a place."""
        if self._tables is None:
            self._tables = []
            for w, f in zip(WIDTHS, self.filters, strict=True):
                single = [self.embed @ f.reshape(w, EMBED, FILTERS)[j] for j in range(w)]
                parts = [(j, (single[j][:, None, :] + single[j + 1][None]).reshape(-1, FILTERS), True) for j in range(0, w - 1, 2)]
                if w % 2:
                    parts.append((w - 1, single[w - 1], False))
                self._tables.append(parts)
        return self._tables

    def probabilities(self, rows: np.ndarray, at_once: int = 512) -> np.ndarray:
        """Class probabilities of every window."""
        out = np.empty((len(rows), len(self.classes)), np.float32)
        for at in range(0, len(rows), at_once):
            part = rows[at : at + at_once]
            pairs = (part[:, :-1].astype(np.int32) << 8) | part[:, 1:]
            pooled = []
            for w, parts, b in zip(WIDTHS, self._prepared(), self.bias, strict=True):
                length, response = WINDOW - w + 1, None
                for j, table, paired in parts:
                    taken = np.take(table, (pairs if paired else part)[:, j : j + length], axis=0, mode="clip")
                    response = taken if response is None else np.add(response, taken, out=response)
                pooled.append(response.max(axis=1) + b)
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            out[at : at + at_once] = _softmax(hidden @ self.out + self.out_bias)
        return out

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Class probabilities of every text: its windows' mean, by their bytes."""
        rows = [windows_of(np.frombuffer(t, np.uint8)) for t in texts]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        every = np.concatenate(rows) if rows else np.empty((0, WINDOW), np.uint8)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
        size = np.full(len(every), WINDOW, np.float32)
        for i, t in enumerate(texts):
            size[starts[i] + counts[i] - 1] = max(1, len(t) - WINDOW * (int(counts[i]) - 1))
        p = self.probabilities(every) * size[:, None]
        return np.add.reduceat(p, starts, axis=0) / np.add.reduceat(size, starts)[:, None] if len(texts) else p


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
