"""A linear-chain conditional random field over the lines of a text, in numpy.

Each line is bad (0) or good (1). A line's score for good is the sum of one weight per feature, where the features are
the bins of its own measures and of the lines before and after it; a 2 x 2 table, fitted with the weights, scores the step from line to line.
Forward-backward gives each line's marginal, and their mean by line length is the document's quality.
"""

from __future__ import annotations

import numpy as np

#: Byte classes: 0 lower, 1 upper, 2 digit, 3 white space, 4 sentence mark, 5 exclamation mark, 6 bar, 7 beyond ASCII, 8 other.
_CLASSES = 9
_CLASS_OF = np.full(256, 8, np.uint8)
_CLASS_OF[ord("a") : ord("z") + 1] = 0
_CLASS_OF[ord("A") : ord("Z") + 1] = 1
_CLASS_OF[ord("0") : ord("9") + 1] = 2
_CLASS_OF[list(b" \t\r\x0b\x0c")] = 3
_CLASS_OF[list(b".,;:?'\"()-")] = 4
_CLASS_OF[ord("!")] = 5
_CLASS_OF[ord("|")] = 6
_CLASS_OF[128:] = 7

#: Upper edges of the bins of a share; a share of nothing has bin 0.
_SHARES = np.array([0.0, 0.005, 0.015, 0.03, 0.06, 0.12, 0.25, 0.5])
_LENGTHS = np.array([0, 8, 24, 64, 128, 256, 512, 1024])
_WORDS = np.array([0, 2, 3, 4, 5, 6, 8, 12])
_REPEATS = np.array([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9])
BINS = 9
#: Measures of a line: shares of upper (of letters), digits, marks, exclamation marks, bars, others; length; bytes per word;
#: whether the line stood earlier in the text; class of the last byte; share of words that repeat one of the line.
MEASURES = 11
#: How strongly the steps are held small, of a likelihood in which all texts together weigh 1.
STEP_KEEP = 0.05


def measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of every line, one column per measure; bytes of every line; lines of every text). A text has a line at least."""
    rows = [t.split(b"\n") for t in texts]
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    lines = [x for r in rows for x in r]
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = _CLASS_OF[np.frombuffer(b"".join(lines), np.uint8)]
    number = np.repeat(np.arange(len(lines)), size)
    per = np.bincount(number * _CLASSES + kinds, minlength=len(lines) * _CLASSES).reshape(len(lines), _CLASSES)
    again = np.zeros(len(lines), np.int64)
    at = 0
    for r in rows:
        if len(r) > 1:
            seen: set[bytes] = set()
            for x in r:
                if x in seen:
                    again[at] = 1
                seen.add(x)
                at += 1
        else:
            at += 1
    split = [x.split() for x in lines]
    repeats = np.fromiter((1 - len(set(w)) / len(w) if w else 0.0 for w in split), float, len(lines))
    letters = per[:, 0] + per[:, 1]
    whole = np.maximum(size, 1)
    last = np.full(len(lines), 8, np.int64)
    ends = np.cumsum(size) - 1
    last[size > 0] = kinds[ends[size > 0]]
    shares = [per[:, 1] / np.maximum(letters, 1), *(per[:, k] / whole for k in (2, 4, 5, 6, 8))]
    out = np.stack([*(np.searchsorted(_SHARES, s) for s in shares), np.searchsorted(_LENGTHS, size), np.searchsorted(_WORDS, size / (per[:, 3] + 1)), again, last, np.searchsorted(_REPEATS, repeats)], axis=1)
    return np.minimum(out, BINS - 1).astype(np.uint8), size, counts


class LineCRF:
    def __init__(self) -> None:
        #: By place (before, own, after), measure and bin; the last bin of a neighbour says that there is none.
        self.weights = np.zeros((3, MEASURES, BINS + 1))
        self.bias = 0.0
        self.steps = np.zeros((2, 2))

    @staticmethod
    def _features(bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(lines, 3, measures): bins of the line before, the line and the line after."""
        out = np.full((len(bins), 3, MEASURES), BINS, np.int64)
        out[:, 1] = bins
        ends = np.cumsum(counts)
        inner = np.ones(len(bins), bool)
        inner[ends - counts] = False
        before = np.flatnonzero(inner)
        out[before, 0] = bins[before - 1]
        out[before - 1, 2] = bins[before]
        return out

    def _scores(self, features: np.ndarray) -> np.ndarray:
        total = np.full(len(features), self.bias)
        for p in range(3):
            for m in range(MEASURES):
                total += self.weights[p, m, features[:, p, m]]
        return total

    def _chains(self, scores: np.ndarray, counts: np.ndarray):
        """Texts of alike length together, so that each step goes over many: (line numbers, which are lines, scores), padded."""
        starts = np.cumsum(counts) - counts
        order = np.argsort(counts, kind="stable")
        at = 0
        while at < len(order):
            most = counts[order[at]] * 1.25 + 4
            end = min(int(np.searchsorted(counts[order], most, "right")), at + 4096)
            block = order[at : max(end, at + 1)]
            length = int(counts[block].max())
            place = np.arange(length)
            live = place[None] < counts[block][:, None]
            index = np.where(live, starts[block][:, None] + place[None], 0)
            yield index, live, np.where(live, scores[index], 0.0)
            at += len(block)

    def marginals(self, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The probability of good of every line."""
        return self._both_ways(bins, counts)[0]

    def _both_ways(self, bins: np.ndarray, counts: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The probability of good of every line, and the expected steps of every kind (from, to), each weighted as the line it leads to."""
        out, steps = np.zeros(len(bins)), np.zeros((2, 2))
        a = np.exp(self.steps - self.steps.max())
        for index, live, s in self._chains(self._scores(self._features(bins, counts)), counts):
            n, length = s.shape
            # Odds as two shares, so that nothing overflows.
            good = 1 / (1 + np.exp(-np.clip(s, -60, 60)))
            emit = np.stack([1 - good, good], axis=2)
            forward = np.empty((n, length, 2))
            f = emit[:, 0]
            forward[:, 0] = f / f.sum(axis=1, keepdims=True)
            for t in range(1, length):
                f = (forward[:, t - 1] @ a) * emit[:, t]
                f = f / np.maximum(f.sum(axis=1, keepdims=True), 1e-300)
                forward[:, t] = np.where(live[:, t, None], f, forward[:, t - 1])
            back = np.ones((n, 2))
            for t in range(length - 1, -1, -1):
                m = forward[:, t] * back
                m /= np.maximum(m.sum(axis=1, keepdims=True), 1e-300)
                here = live[:, t]
                out[index[here, t]] = m[here, 1]
                if t:
                    if weight is not None:
                        pair = forward[:, t - 1, :, None] * a * (emit[:, t] * back)[:, None, :]
                        pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)
                        steps += (pair * (weight[index[:, t]] * here)[:, None, None]).sum(axis=0)
                    b = (emit[:, t] * back) @ a.T
                    b /= np.maximum(b.sum(axis=1, keepdims=True), 1e-300)
                    back = np.where(here[:, None], b, back)
        return out, steps

    def fit(self, bins: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.08, keep: float = 2e-3) -> None:
        """Maximum likelihood of weights and steps together, all held small, where each line has its text's label. Each text counts alike, and
        so do the labels together, by Adam over all texts. By these labels lines never leave their text's label, so that without the
        pull to 0 the steps would grow for ever."""
        features = self._features(bins, counts)
        share = np.bincount(labels, minlength=2).astype(float)
        per_text = (len(labels) / np.maximum(share, 1) / max(1, (share > 0).sum()))[labels] / len(labels)
        line_label = np.repeat(labels, counts).astype(float)
        line_weight = np.repeat(per_text / counts, counts)
        flat = (np.arange(3)[None, :, None] * MEASURES + np.arange(MEASURES)[None, None]) * (BINS + 1) + features
        n = self.weights.size
        state = np.zeros(n + 5), np.zeros(n + 5)
        for t in range(1, rounds + 1):
            g = self._gradient(bins, counts, line_label, line_weight, flat, keep)
            m, v = state
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
            self.weights += move[:n].reshape(self.weights.shape)
            self.bias += float(move[n])
            self.steps += move[n + 1 :].reshape(2, 2)

    def _gradient(self, bins: np.ndarray, counts: np.ndarray, line_label: np.ndarray, line_weight: np.ndarray, flat: np.ndarray, keep: float) -> np.ndarray:
        """Of the weighted log-likelihood less the squares of weights and steps: by weight, by bias, by step. What was seen less what is expected."""
        good, expected = self._both_ways(bins, counts, line_weight)
        error = (line_label - good) * line_weight
        inner = np.ones(len(bins), bool)
        inner[np.cumsum(counts) - counts] = False
        to = np.flatnonzero(inner)
        label = line_label.astype(int)
        seen = np.bincount(label[to - 1] * 2 + label[to], line_weight[to], minlength=4).reshape(2, 2)
        by_weight = np.bincount(flat.ravel(), np.repeat(error, 3 * MEASURES), minlength=self.weights.size) - keep / 10 * self.weights.ravel()
        return np.concatenate([by_weight, [error.sum()], (seen - expected - STEP_KEEP * self.steps).ravel()])

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Quality of every text: its lines' marginals, by length. An empty text's one empty line counts as one byte."""
        if not texts:
            return np.zeros(0)
        bins, size, counts = measures(texts)
        good = self.marginals(bins, counts)
        starts = np.cumsum(counts) - counts
        weight = size + 1.0
        return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0, 1)
