"""A skip-chain conditional random field with loopy message passing (numpy, inside tasks).

Nodes are the units of many documents at once.  Edges have a kind: 0 ties a unit
to the next one of its document, the others tie distant units that repeat or
resemble each other.  Each kind has one table of weights [label, label] that all
its edges share.  Marginals come from sum-product messages over all edges in
step, until they settle or after ROUNDS rounds; a chain without skip edges is a
tree, where that is exact as soon as the rounds reach its length.
"""

from __future__ import annotations

import numpy as np

ROUNDS, SETTLED, DAMPING = 40, 1e-4, 0.2
#: Log-weight of the labels that an observed unit doesn't have.
EXCLUDED = -60.0
_CHUNK = 100_000


class Model:
    """``table[feature, label]`` and ``pair[kind, label, label]`` (log weights)."""

    def __init__(self, table: np.ndarray, pair: np.ndarray) -> None:
        self.table, self.pair = table, pair


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _send(at_node: np.ndarray, back: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Messages along edges: what the sending node knows without ``back``, through ``pair`` [edge, from, to]."""
    out = np.empty_like(back)
    for i in range(0, len(back), _CHUNK):
        s = slice(i, i + _CHUNK)
        m = _log_sum((at_node[s] - back[s])[:, :, None] + pair[s], 1)
        out[s] = m - m.max(axis=1, keepdims=True)
    return out


class _PerEdge:
    """``pair[kind]`` (or transposed) of a slice of edges, without a table of all edges."""

    def __init__(self, pair: np.ndarray, kind: np.ndarray, turned: bool) -> None:
        self.pair, self.kind = pair.transpose(0, 2, 1) if turned else pair, kind

    def __getitem__(self, s: slice) -> np.ndarray:
        return self.pair[self.kind[s]]


def messages(node: np.ndarray, u: np.ndarray, v: np.ndarray, kind: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS):
    """Settled messages to ``v`` and to ``u`` of each edge, and all nodes' log beliefs."""
    to_v, to_u = np.zeros((len(u), node.shape[1])), np.zeros((len(u), node.shape[1]))
    forward, backward = _PerEdge(pair, kind, False), _PerEdge(pair, kind, True)

    def beliefs():
        b = node.copy()
        np.add.at(b, v, to_v)
        np.add.at(b, u, to_u)
        return b

    b = beliefs()
    for _ in range(rounds if len(u) else 0):
        new_v, new_u = _send(b[u], to_u, forward), _send(b[v], to_v, backward)
        change = max(np.abs(new_v - to_v).max(), np.abs(new_u - to_u).max())
        to_v += (1 - DAMPING) * (new_v - to_v)
        to_u += (1 - DAMPING) * (new_u - to_u)
        b = beliefs()
        if change < SETTLED:
            break
    return to_v, to_u, b


def _share(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def node_weights(model: Model, ids: np.ndarray, bars: np.ndarray, observed: np.ndarray) -> np.ndarray:
    """Log weights of the nodes; ``bars`` is added to them, ``observed`` is the label of a unit or -1."""
    e = model.table[ids].sum(axis=1) + bars
    seen = np.flatnonzero(observed >= 0)
    e[seen] = EXCLUDED
    e[seen, observed[seen]] = 0.0
    return e


def marginals(model: Model, ids: np.ndarray, bars: np.ndarray, observed: np.ndarray, u: np.ndarray, v: np.ndarray,
              kind: np.ndarray) -> np.ndarray:
    """Probability of each label of each unit."""
    return _share(messages(node_weights(model, ids, bars, observed), u, v, kind, model.pair)[2])


def train(ids: np.ndarray, labels: np.ndarray, u: np.ndarray, v: np.ndarray, kind: np.ndarray, features: int, prior: np.ndarray,
          steps: int = 60, rate: float = 0.15, l2: float = 1e-2, prior_weight: float = 0.05) -> Model:
    """Maximum likelihood (expectations by message passing) with Gaussian priors: 0 for features, ``prior`` for pairs.

    Without bars: what a form looks like is learned from all units, also those of barred kinds.
    """
    n, size = max(1, len(ids)), prior.shape[1]
    params = [np.zeros((features, size)), prior.copy()]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    seen_node = np.zeros((len(ids), size))
    seen_node[np.arange(len(ids)), labels] = 1
    flat = ids.ravel()
    for step in range(1, steps + 1):
        table, pair = params
        to_v, to_u, b = messages(table[ids].sum(axis=1), u, v, kind, pair, 12)
        wrong = seen_node - _share(b)
        g_table = np.stack([np.bincount(flat, np.repeat(wrong[:, k], ids.shape[1]), features) for k in range(size)], axis=1)
        g_pair = np.zeros_like(pair)
        for i in range(0, len(u), _CHUNK):
            s = slice(i, i + _CHUNK)
            joint = (b[u[s]] - to_u[s])[:, :, None] + (b[v[s]] - to_v[s])[:, None, :] + pair[kind[s]]
            p = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            p /= p.sum(axis=(1, 2), keepdims=True)
            np.add.at(g_pair, kind[s], -p)
            np.add.at(g_pair, (kind[s], labels[u[s]], labels[v[s]]), 1.0)
        grads = [g_table / n - l2 * table, g_pair / n - prior_weight * (pair - prior) / 10]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] + rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-9)
    return Model(*params)
