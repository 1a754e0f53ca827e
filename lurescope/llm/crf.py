"""A two-label linear-chain conditional random field over words (numpy, inside tasks).

Labels are 0 (clean) and 1 (toxic).  A word's features are itself and its
prefixes, hashed into a weight table; neighbouring labels are tied by a 2 x 2
transition table.  Forward and backward passes run over many sequences at once,
in log-odds, so a step is a few vector operations.
"""

from __future__ import annotations

import numpy as np
import xxhash

TABLE_BITS = 17
PREFIXES = (4, 5, 6, 7)
FEATURES = len(PREFIXES) + 1
_CACHE_WORDS = 400_000


def word_features(word: bytes) -> list[bytes]:
    """The word and its prefixes (as text characters); short words have fewer."""
    text = word.decode("utf-8", "replace")
    return [b"=" + word] + [b"^" + text[:k].encode() for k in PREFIXES if len(text) > k]


def feature_ids(word: bytes) -> list[int]:
    ids = [xxhash.xxh32_intdigest(f) & ((1 << TABLE_BITS) - 1) for f in word_features(word)]
    return ids + [1 << TABLE_BITS] * (FEATURES - len(ids))  # the last slot always weighs 0


class Model:
    """Weights: the feature table (label 1 against 0), a bias, and transitions[from, to]."""

    def __init__(self, table=None, bias: float = 0.0, transitions=None) -> None:
        self.table = np.zeros((1 << TABLE_BITS) + 1, np.float32) if table is None else table
        self.bias, self.transitions = bias, np.zeros((2, 2)) if transitions is None else transitions


def forward(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds of the forward scores; ``e``: log-odds of the words, a sequence per column."""
    a = np.empty_like(e)
    if len(e):
        a[0] = e[0]
    for i in range(1, len(e)):
        a[i] = e[i] + np.logaddexp(t[0, 1], t[1, 1] + a[i - 1]) - np.logaddexp(t[0, 0], t[1, 0] + a[i - 1])
    return a


def backward(e: np.ndarray, t: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Log-odds of the backward scores; ``inside``: whether a step belongs to its sequence."""
    b = np.zeros_like(e)
    for i in range(len(e) - 2, -1, -1):
        x = e[i + 1] + b[i + 1]
        b[i] = np.where(inside[i + 1], np.logaddexp(t[1, 0], t[1, 1] + x) - np.logaddexp(t[0, 0], t[0, 1] + x), 0.0)
    return b


def marginals(e: np.ndarray, t: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each word, given its whole sequence."""
    return 1 / (1 + np.exp(-np.clip(forward(e, t) + backward(e, t, inside), -50, 50)))


def train(ids: np.ndarray, labels: np.ndarray, inside: np.ndarray, steps: int = 80, rate: float = 0.3, l2: float = 1e-5) -> Model:
    """Maximum likelihood by Adam; arrays are (step, sequence) with ``ids`` (step, sequence, FEATURES)."""
    size = (1 << TABLE_BITS) + 1
    m = Model(np.zeros(size), -3.0)
    n = max(1, int(inside.sum()))
    params = [m.table, np.array([m.bias]), m.transitions]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    pair = inside[1:] & inside[:-1]
    seen = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = ((labels[:-1] == i) & (labels[1:] == j) & pair).sum()
    flat = ids[inside].ravel()
    for step in range(1, steps + 1):
        table, bias, t = params
        e = table[ids].sum(axis=2) + bias[0]
        a, b = forward(e, t), backward(e, t, inside)
        p = 1 / (1 + np.exp(-np.clip(a + b, -50, 50)))
        wrong = np.where(inside, labels - p, 0.0)
        g_table = np.bincount(flat, np.repeat(wrong[inside], FEATURES), size) - l2 * n * table
        g_table[-1] = 0
        # expected transitions: the four joint weights of each neighbouring pair
        x = e[1:] + b[1:]
        w = np.stack([np.broadcast_to(t[0, 0], x.shape), t[0, 1] + x, t[1, 0] + a[:-1], t[1, 1] + a[:-1] + x])
        w = np.exp(w - w.max(axis=0))
        w = w / w.sum(axis=0) * pair
        expected = w.reshape(4, -1).sum(axis=1).reshape(2, 2)
        grads = [g_table / n, np.array([wrong.sum()]) / n, (seen - expected) / n]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] + rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-9)
    return Model(params[0].astype(np.float32), float(params[1][0]), params[2])


class Emissions(dict):
    """Log-odds of each word under a model; forgets all when it holds too many words."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        e = self[word] = float(self.model.table[feature_ids(word)].sum()) + self.model.bias
        return e


    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def tag(sequences: list[np.ndarray], transitions: np.ndarray, cells: int = 1 << 20) -> list[np.ndarray]:
    """Marginals of sequences of word log-odds, in order; works through blocks of similar length."""
    out: list[np.ndarray] = [np.zeros(0)] * len(sequences)
    order = sorted((i for i, e in enumerate(sequences) if len(e)), key=lambda i: len(sequences[i]))
    at = 0
    while at < len(order):
        end, longest = at + 1, len(sequences[order[at]])
        while end < len(order) and (end + 1 - at) * len(sequences[order[end]]) <= cells:
            longest, end = len(sequences[order[end]]), end + 1
        block = order[at:end]
        e = np.zeros((longest, len(block)))
        inside = np.zeros((longest, len(block)), bool)
        for k, i in enumerate(block):
            e[:len(sequences[i]), k] = sequences[i]
            inside[:len(sequences[i]), k] = True
        p = marginals(e, transitions, inside)
        for k, i in enumerate(block):
            out[i] = p[:len(sequences[i]), k].copy()
        at = end
    return out
