"""A small linear-chain conditional random field over binary features: maximum-likelihood
training by forward-backward and Adam steps, decoding by Viterbi.

It serves two operators, which train it on the driver from a bounded set of labelled
sequences and decode inside tasks.
"""

from __future__ import annotations

import numpy as np

# Two labels, by their index.
OTHER, MAIN = 0, 1


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class LinearChain:
    """Weights of features (one row each, and a zero row for padding), of label pairs and of
    first labels."""

    def __init__(self, n_features: int, n_labels: int = 2):
        self.n = n_features
        self.features = np.zeros((n_features + 1, n_labels))
        self.pairs = np.zeros((n_labels, n_labels))
        self.first = np.zeros(n_labels)

    def padded(self, sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """(feature ids [sequence, position, slot], lengths); n_features pads."""
        length = np.array([len(s) for s in sequences])
        slots = max((len(f) for s in sequences for f in s), default=1)
        ids = np.full((len(sequences), int(length.max(initial=0)), slots), self.n, np.int64)
        for i, s in enumerate(sequences):
            for t, f in enumerate(s):
                ids[i, t, :len(f)] = f
        return ids, length

    def fit(self, sequences: list[list[list[int]]], labels: list[list[int]], steps: int = 120, rate: float = 0.2,
            decay: float = 5e-5) -> "LinearChain":
        """Gradient steps on the mean log-likelihood per position, with an L2 penalty."""
        if not sequences:
            return self
        ids, length = self.padded(sequences)
        s, t, _ = ids.shape
        k = self.pairs.shape[0]
        inside = np.arange(t)[None, :] < length[:, None]
        gold = np.zeros((s, t), np.int64)
        for i, y in enumerate(labels):
            gold[i, :len(y)] = y
        truth = np.eye(k)[gold] * inside[..., None]
        linked = inside[:, 1:]
        true_pairs = np.einsum("sta,stb->ab", truth[:, :-1], truth[:, 1:] * linked[..., None])
        params = [self.features, self.pairs, self.first]
        mean = [np.zeros_like(p) for p in params]
        square = [np.zeros_like(p) for p in params]
        total = inside.sum()
        for step in range(1, steps + 1):
            score = self.features[ids].sum(axis=2)
            ahead = np.zeros((s, t, k))
            ahead[:, 0] = score[:, 0] + self.first
            for j in range(1, t):
                moved = _logsum(ahead[:, j - 1, :, None] + self.pairs, 1) + score[:, j]
                ahead[:, j] = np.where(inside[:, j, None], moved, ahead[:, j - 1])
            back = np.zeros((s, t, k))
            expected = np.zeros((k, k))
            norm = _logsum(ahead[:, -1], 1)
            for j in range(t - 1, 0, -1):
                joint = ahead[:, j - 1, :, None] + self.pairs + (score[:, j] + back[:, j])[:, None, :]
                expected += (np.exp(joint - norm[:, None, None]) * inside[:, j, None, None]).sum(axis=0)
                back[:, j - 1] = np.where(inside[:, j, None], _logsum(joint - ahead[:, j - 1, :, None], 2), 0.0)
            marginal = np.exp(ahead + back - norm[:, None, None]) * inside[..., None]
            off = truth - marginal
            grad = np.zeros_like(self.features)
            np.add.at(grad, ids.reshape(s * t, -1), off.reshape(s * t, 1, k))
            grad[self.n] = 0
            grads = [grad, true_pairs - expected, off[:, 0].sum(axis=0)]
            for p, g, m, q in zip(params, grads, mean, square):
                g = g / total - decay * p
                m += 0.1 * (g - m)
                q += 0.01 * (g * g - q)
                p += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.99 ** step)) + 1e-8)
        return self

    def decode(self, sequence: list[list[int]]) -> list[int]:
        """The most likely labels; ties go to the higher label."""
        if not sequence:
            return []
        slots = max(map(len, sequence))
        ids = np.array([f + [self.n] * (slots - len(f)) for f in sequence], np.int64)
        return viterbi(self.features[ids].sum(axis=1), self.pairs, self.first)


def viterbi(score: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> list[int]:
    """Two labels: the best path through [position, label] scores, in plain floats."""
    (p00, p01), (p10, p11) = pairs.tolist()
    rows = score.tolist()
    a, b = rows[0][0] + first[0], rows[0][1] + first[1]
    came = []
    for x, y in rows[1:]:
        from0 = b + p10 >= a + p00
        from1 = b + p11 >= a + p01
        a, b = (b + p10 if from0 else a + p00) + x, (b + p11 if from1 else a + p01) + y
        came.append((from0, from1))
    label = int(b >= a)
    path = [label]
    for step in reversed(came):
        label = int(step[label])
        path.append(label)
    return path[::-1]
