"""A linear-chain conditional random field in NumPy: training by Adam, decoding by Viterbi, in batches."""

from __future__ import annotations

import numpy as np


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    """Tags sequences of feature rows; W: features by tags, T: tag to next tag."""

    def __init__(self, n_features: int, n_tags: int):
        self.W = np.zeros((n_features, n_tags))
        self.T = np.zeros((n_tags, n_tags))

    def save(self, path: str) -> None:
        """Writes the weights to a local file, to be used again without training."""
        np.savez_compressed(path, W=self.W, T=self.T)

    @staticmethod
    def load(path: str) -> Crf:
        """The field that save wrote."""
        with np.load(path) as kept:
            field = Crf(*kept["W"].shape)
            field.W, field.T = kept["W"], kept["T"]
        return field

    def _gradient(self, X: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean log loss per element, with respect to W and T."""
        # longest sequences first: at each place only the first live[t] of them go on, so short ones cost nothing
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        starts = (np.cumsum(lengths) - lengths)[order]
        width, n, k, total = int(sizes[0]), len(sizes), self.W.shape[1], len(X)
        live = np.searchsorted(-sizes, -np.arange(width), "left")
        rows = [starts[: live[t]] + t for t in range(width)]
        gold = np.zeros((total, k))
        gold[np.arange(total), tags] = 1
        gold_pairs = sum(gold[rows[t - 1][: live[t]]].T @ gold[rows[t]] for t in range(1, width)) + np.zeros((k, k))
        E = (X @ self.W.astype(X.dtype)).astype(float)
        forward, backward = np.empty((total, k)), np.zeros((total, k))
        forward[rows[0]] = E[rows[0]]
        for t in range(1, width):
            before = rows[t - 1][: live[t]]
            forward[rows[t]] = _logsum(forward[before][:, :, None] + self.T[None], 1) + E[rows[t]]
        for t in range(width - 2, -1, -1):
            after = rows[t + 1]
            backward[rows[t][: live[t + 1]]] = _logsum(self.T[None] + (E[after] + backward[after])[:, None, :], 2)
        z = _logsum(forward[starts + sizes - 1], 1)
        of = np.empty(total, dtype=np.int64)
        for t in range(width):
            of[rows[t]] = np.arange(live[t])
        node = np.exp(forward + backward - z[of][:, None])
        expected = np.zeros((k, k))
        for t in range(1, width):
            before, here = rows[t - 1][: live[t]], rows[t]
            pair = forward[before][:, :, None] + self.T[None] + (E[here] + backward[here])[:, None, :] - z[: live[t], None, None]
            expected += np.exp(pair).sum(axis=0)
        return (X.T @ (node - gold).astype(X.dtype)) / total, (expected - gold_pairs) / total

    def fit(self, X: np.ndarray, tags: np.ndarray, lengths: np.ndarray, rounds: int = 200, rate: float = 0.05, ridge: float = 1e-4, batch: int = 1 << 30) -> Crf:
        """X: one row per element of all sequences, one after another; lengths: elements of each sequence; batch: sequences a step looks
        at, drawn anew each round. Steps are Adam's; the rate falls to a tenth over the rounds."""
        rng = np.random.default_rng(5)
        first = np.cumsum(lengths) - lengths
        moments = [np.zeros_like(self.W), np.zeros_like(self.W), np.zeros_like(self.T), np.zeros_like(self.T)]
        step = 0
        for r in range(rounds):
            drawn = rng.permutation(len(lengths)) if batch < len(lengths) else np.arange(len(lengths))
            for lo in range(0, len(drawn), batch):
                some = np.sort(drawn[lo : lo + batch])
                size = lengths[some]
                at = np.repeat(first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                dW, dT = self._gradient(X[at], tags[at], size) if batch < len(lengths) else self._gradient(X, tags, lengths)
                step += 1
                for i, (theta, d) in enumerate(((self.W, dW + ridge * self.W), (self.T, dT + ridge * self.T))):
                    m, v = moments[2 * i], moments[2 * i + 1]
                    m *= 0.9
                    m += 0.1 * d
                    v *= 0.99
                    v += 0.01 * d * d
                    theta -= rate * 0.1 ** (r / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, E: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags, one per row of E, the scores of all sequences' elements one after another. Longest sequences come first and leave
        when they end, so nothing is padded: memory is that of the elements, however uneven the lengths."""
        total, k = E.shape[0], self.T.shape[0]
        out = np.zeros(total, dtype=np.int64)
        if not total:
            return out
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        starts = (np.cumsum(lengths) - lengths)[order]
        width = int(sizes[0])
        live = np.searchsorted(-sizes, -np.arange(width), "left")
        best, back = E.astype(float), np.zeros((total, k), dtype=np.int8)
        for t in range(1, width):
            here = starts[: live[t]] + t
            through = best[here - 1][:, :, None] + self.T[None]
            back[here] = through.argmax(axis=1)
            best[here] += through.max(axis=1)
        ends = starts + sizes - 1
        out[ends] = best[ends].argmax(axis=1)
        for t in range(width - 1, 0, -1):
            here = starts[: live[t]] + t
            out[here - 1] = back[here, out[here]]
        return out
