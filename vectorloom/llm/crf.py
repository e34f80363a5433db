"""Linear-chain conditional random field over hashed features, in NumPy.

Documents of a block lie behind one another in one chain. A separator that can only be outside stands
between two of them, so no document influences another. Chains are decoded exactly in parallel: the chain is
cut into equal pieces, each piece is reduced to its transfer matrix, the matrices are scanned, and then all
pieces are decoded at once from their true borders. State 0 is outside.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PIECE = 256
FAR = -1e9


@dataclass
class Model:
    weights: np.ndarray  # buckets x states, float32
    trans: np.ndarray  # from x to

    @property
    def states(self) -> int:
        return len(self.trans)

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        mask = np.uint64(len(self.weights) - 1)
        out = np.zeros((len(features[0]), self.states), np.float32)
        for f in features:
            out += np.take(self.weights, (f & mask).astype(np.int64), axis=0)
        return out


def chain(emissions: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces x steps layout (steps, states, pieces) with separators, and each token's place in the chain."""
    place = np.arange(len(doc)) + doc + 1
    total = len(doc) + n_docs + 1
    pieces = max(1, -(-total // PIECE))
    flat = np.full((pieces * PIECE, emissions.shape[1]), FAR)
    flat[:, 0] = 0
    flat[place] = emissions
    return np.ascontiguousarray(flat.reshape(pieces, PIECE, -1).transpose(1, 2, 0)), place


def viterbi(model: Model, emissions: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """The best state of each token."""
    if not len(doc):
        return np.zeros(0, np.uint8)
    e, place = chain(emissions, doc, n_docs)
    t, s, (steps, _, k) = model.trans, model.states, e.shape
    p = [np.full((s, k), FAR) for _ in range(s)]
    for m in range(s):
        p[m][m] = 0
    for x in e:
        p = [np.maximum.reduce([p[m] + t[m, j] for m in range(s)]) + x[j] for j in range(s)]
    matrix = np.stack(p, -1)  # before, piece, after
    enter = np.empty((s, k))
    v = np.full(s, FAR)
    v[0] = 0
    for i in range(k):
        v = v - v.max()
        enter[:, i] = v
        v = (v[:, None] + matrix[:, i]).max(0)
    last = int(v.argmax())
    back = np.empty((steps, s, k), np.uint8)
    d = list(enter)
    for n, x in enumerate(e):
        new = []
        for j in range(s):
            best, arg = d[0] + t[0, j], np.zeros(k, np.uint8)
            for m in range(1, s):
                c = d[m] + t[m, j]
                better = c > best
                best = np.where(better, c, best)
                arg[better] = m
            back[n, j] = arg
            new.append(best + x[j])
        d = new
    at = np.arange(k)
    cur = np.repeat(np.arange(s)[:, None], k, 1)
    for n in range(steps - 1, -1, -1):
        cur = back[n][cur, at]
    ends = np.empty(k, np.int64)
    for i in range(k - 1, -1, -1):
        ends[i] = last
        last = int(cur[last, i])
    out = np.empty((steps, k), np.uint8)
    state = ends
    for n in range(steps - 1, -1, -1):
        out[n] = state
        state = back[n][state, at]
    return out.T.reshape(-1)[place]


def _scan(mats: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row vectors before each of the matrices (piece, from, to), scaled to sum 1."""
    out = np.empty((len(mats), len(first)))
    v = first
    for i, m in enumerate(mats):
        out[i] = v
        v = v @ m
        v = v / v.sum()
    return out


def _passes(model: Model, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward messages, backward messages and emissions (steps, states, pieces)."""
    e = np.exp(np.clip(e - e.max(1, keepdims=True), -60, 0))
    t, s, (steps, _, k) = np.exp(model.trans - model.trans.max()), model.states, e.shape
    first = np.zeros(s)
    first[0] = 1
    p = [np.repeat(np.eye(s)[m][:, None], k, 1) for m in range(s)]
    for n, x in enumerate(e):
        p = [sum(p[m] * t[m, j] for m in range(s)) * x[j] for j in range(s)]
        if n % 16 == 15:
            z = sum(p).max(0)
            p = [q / z for q in p]
    mats = np.stack(p, -1).transpose(1, 0, 2)
    a = list(_scan(mats, first).T)
    fore, rear = np.empty((steps, s, k)), np.empty((steps, s, k))
    for n, x in enumerate(e):
        a = [sum(a[m] * t[m, j] for m in range(s)) * x[j] for j in range(s)]
        z = sum(a)
        for j in range(s):
            a[j] = fore[n, j] = a[j] / z
    b = list(_scan(mats[::-1].transpose(0, 2, 1), np.full(s, 1 / s))[::-1].T)
    for n in range(steps - 1, -1, -1):
        x = e[n]
        for j in range(s):
            rear[n, j] = b[j]
        b = [b[j] * x[j] for j in range(s)]
        b = [sum(b[j] * t[m, j] for j in range(s)) for m in range(s)]
        z = sum(b)
        b = [q / z for q in b]
    return fore, rear, e


def _rows(x: np.ndarray) -> np.ndarray:
    """Chain order: from (steps, states, pieces) to positions x states."""
    return x.transpose(2, 0, 1).reshape(-1, x.shape[1])


def marginals(model: Model, emissions: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Forward-backward: tokens x states probabilities."""
    if not len(doc):
        return np.zeros((0, model.states))
    e, place = chain(emissions, doc, n_docs)
    fore, rear, _ = _passes(model, e)
    fore *= rear
    out = _rows(fore)[place]
    return out / out.sum(1, keepdims=True)


def fit(features: list[np.ndarray], gold: np.ndarray, doc: np.ndarray, n_docs: int, states: int, bits: int = 17, rounds: int = 30, rate: float = 0.2, l2: float = 1e-3, dead: int | None = None) -> Model:
    """Maximum likelihood by full-batch Adam, which empties ``features``. ``gold`` has each token's state; features with the value ``dead`` weigh nothing."""
    size = 1 << bits
    model = Model(np.zeros((size, states), np.float32), np.zeros((states, states)))
    # features are let go one by one, as they are turned into narrow places of the weights in use
    idx, seen_buckets = [], np.zeros(size, bool)
    while features:
        idx.append((features.pop(0) & np.uint64(size - 1)).astype(np.int32))
        seen_buckets[idx[-1]] = True
    used = np.flatnonzero(seen_buckets)
    rank = (np.cumsum(seen_buckets) - 1).astype(np.int32)
    idx = [rank[i] for i in idx]
    w = np.zeros((len(used), states))
    moments = [np.zeros((2, *x.shape)) for x in (w, model.trans)]

    def step(n: int, g: np.ndarray, m: np.ndarray) -> np.ndarray:
        m[0] += 0.1 * (g - m[0])
        m[1] += 0.05 * (g * g - m[1])
        return rate * (m[0] / (1 - 0.9**n)) / (np.sqrt(m[1] / (1 - 0.95**n)) + 1e-6)

    hot = np.eye(states)[gold]
    place = np.arange(len(doc)) + doc + 1
    states_of = np.zeros(-(-(len(doc) + n_docs + 1) // PIECE) * PIECE, np.int64)
    states_of[place] = gold
    seen = np.zeros((states, states))
    np.add.at(seen, (states_of[:-1], states_of[1:]), 1)
    for n in range(1, rounds + 1):
        e = sum(w[i] for i in idx).astype(np.float32)
        fore, rear, own = (_rows(x) for x in _passes(model, chain(e, doc, n_docs)[0]))
        p = (fore * rear)[place]
        r = hot - p / p.sum(1, keepdims=True)
        g = np.zeros_like(w)
        for i in idx:
            for s in range(states):
                g[:, s] += np.bincount(i, r[:, s], len(used))
        g -= l2 * w
        if dead is not None:
            g[used == dead & (size - 1)] = 0
        w += step(n, g, moments[0])
        q = fore[:-1, :, None] * np.exp(model.trans) * (rear * own)[1:, None, :]
        q /= q.sum((1, 2), keepdims=True)
        model.trans = model.trans + step(n, seen - q.sum(0) - l2 * model.trans, moments[1])
    model.weights[used] = w
    return model
