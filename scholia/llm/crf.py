"""Linear-chain conditional random fields over hashed features, in numpy.

A position's score for each label is the sum of its features' weights; weights of neighbouring
labels are learned beside them. Texts are handled together, cut into pieces of ``PIECE``
positions: products of the pieces' matrices carry the chain across the cuts, so that results
are those of the whole chain while the number of numpy steps stays small.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

PIECE = 64


def _layout(ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first position, length, number within its chain) of each piece of each chain."""
    n = np.diff(ptr)
    k = -(-n // PIECE)
    num = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    first = np.repeat(ptr[:-1], k) + num * PIECE
    return first, np.minimum(PIECE, np.repeat(ptr[1:], k) - first), num


def _norm(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-30)


def marginals(scores: np.ndarray, ptr: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Label probabilities of each position by forward-backward over each chain ptr[i]:ptr[i + 1]."""
    n, labels = scores.shape
    if not n:
        return scores
    x = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-12
    a = np.exp(trans - trans.max()) + 1e-12
    first, size, num = _layout(ptr)
    order = np.argsort(-size, kind="stable")
    first, size, num = first[order], size[order], num[order]
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))]  # pieces longer than t
    # products of each piece's steps, as maps from the label before it to the label at its end
    prod = np.broadcast_to(np.eye(labels), (len(first), labels, labels)).copy()
    begins = (num == 0)[:, None]
    for t, k in enumerate(live):
        if t == 0:  # no label stands before a chain's first position
            step = np.where(begins[:, :, None], np.eye(labels), a) * x[first][:, None, :]
            prod[:] = step / step.sum(axis=(1, 2), keepdims=True)
            continue
        step = (prod[:k].reshape(-1, labels) @ a).reshape(k, labels, labels) * x[first[:k] + t][:, None, :]
        prod[:k] = step / step.sum(axis=(1, 2), keepdims=True)
    most = int(num.max()) + 1
    in_order = np.argsort(num, kind="stable")
    by_num = np.split(in_order, np.searchsorted(num[in_order], np.arange(1, most)))
    chain = np.empty(len(first), np.int64)
    chain[:] = np.searchsorted(ptr, first, "right") - 1
    into = np.full((len(first), labels), 1 / labels)
    out = np.ones((len(first), labels))
    if most > 1:
        state = np.full((len(ptr) - 1, labels), 1 / labels)
        for own in by_num:
            c = chain[own]
            into[own] = state[c]
            state[c] = _norm(np.einsum("kl,klm->km", state[c], prod[own]))
        state = np.ones((len(ptr) - 1, labels))
        for own in reversed(by_num):
            c = chain[own]
            out[own] = state[c]
            state[c] = _norm(np.einsum("klm,km->kl", prod[own], state[c]))
    alpha = np.empty((n, labels))
    cur = into.copy()
    for t, k in enumerate(live):
        at = first[:k] + t
        before = cur[:k] @ a if t else np.where(begins, 1 / labels, cur @ a)
        cur[:k] = _norm(before * x[at])
        alpha[at] = cur[:k]
    cur = out.copy()
    for t in range(len(live) - 1, -1, -1):
        k = live[t]
        at = first[:k] + t
        alpha[at] *= cur[:k]
        cur[:k] = _norm((cur[:k] * x[at]) @ a.T)
    return _norm(alpha)


def expectations(scores: np.ndarray, ptr: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities of each position, expected number of each pair of neighbouring labels), exact, all chains in step; for training, where chains are short."""
    n, labels = scores.shape
    x = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-200
    a = np.exp(trans.astype(np.float64) - trans.max())
    size = np.diff(ptr)
    order = np.argsort(-size, kind="stable")
    first, size = ptr[:-1][order], size[order]
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]) if len(size) else 0)]
    alpha, beta = np.empty((n, labels)), np.empty((n, labels))
    cur = np.ones((len(first), labels))
    for t, k in enumerate(live):
        at = first[:k] + t
        cur[:k] = _norm((cur[:k] @ a if t else 1.0) * x[at])
        alpha[at] = cur[:k]
    cur = np.ones((len(first), labels))
    for t in range(len(live) - 1, -1, -1):
        k = live[t]
        at = first[:k] + t
        beta[at] = cur[:k]
        cur[:k] = _norm((cur[:k] * x[at]) @ a.T)
    inner = np.ones(n, bool)
    inner[ptr[:-1][np.diff(ptr) > 0]] = False
    b = np.flatnonzero(inner)
    left, right = alpha[b - 1], x[b] * beta[b]
    total = ((left @ a) * right).sum(axis=1, keepdims=True)
    return _norm(alpha * beta), ((left / total).T @ right) * a


def viterbi(scores: np.ndarray, ptr: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels of each chain: all chains in step, long ones by pieces, whose best ways from each label to each are joined at the cuts."""
    best = np.zeros(len(scores), np.int8)
    size = np.diff(ptr)
    long = size > 4 * PIECE
    _in_step(scores, ptr[:-1][~long], size[~long], trans, best)
    for i in np.flatnonzero(long).tolist():
        _by_pieces(scores[ptr[i] : ptr[i + 1]], trans, best[ptr[i] : ptr[i + 1]])
    return best


def _in_step(scores: np.ndarray, first: np.ndarray, size: np.ndarray, trans: np.ndarray, best: np.ndarray) -> None:
    labels = scores.shape[1]
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    if not len(size) or not size[0]:
        return
    back = np.zeros((len(scores), labels), np.int8)
    cur = np.zeros((len(first), labels))
    for t in range(int(size[0])):
        k = int(np.searchsorted(-size, -t, "left"))
        at = first[:k] + t
        if t == 0:
            cur[:k] = scores[at]
            continue
        step = cur[:k, :, None] + trans
        back[at] = step.argmax(axis=1)
        cur[:k] = step.max(axis=1) + scores[at]
    # cur holds each chain's last row of values
    lab = cur.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        k = int(np.searchsorted(-size, -t, "left"))
        at = first[:k] + t
        best[at] = lab[:k]
        if t:
            lab[:k] = back[at, lab[:k]]


def _by_pieces(scores: np.ndarray, trans: np.ndarray, best: np.ndarray) -> None:
    """One long chain: pieces of like length in step, from every label that may stand before a piece."""
    n, labels = scores.shape
    width = int(np.ceil(np.sqrt(n)))
    first = np.arange(0, n, width)
    size = np.minimum(width, n - first)
    back = np.zeros((n, labels, labels), np.int8)  # position, label before the piece, label
    cur = trans[None] + scores[first][:, None, :]
    cur[0] = scores[0]
    for t in range(1, width):
        k = len(first) if t < size[-1] else len(first) - 1
        at = first[:k] + t
        step = cur[:k, :, :, None] + trans
        back[at] = step.argmax(axis=2)
        cur[:k] = step.max(axis=2) + scores[at][:, None, :]
    value, into = cur[0, 0], np.zeros((len(first), labels), np.int8)
    for p in range(1, len(first)):
        way = value[:, None] + cur[p]
        into[p] = way.argmax(axis=0)
        value = way.max(axis=0)
    last, before = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    last[-1] = int(value.argmax())
    for p in range(len(first) - 1, 0, -1):
        before[p] = last[p - 1] = into[p, last[p]]
    lab = last.copy()
    for t in range(width - 1, -1, -1):
        k = len(first) if t < size[-1] else len(first) - 1
        at = first[:k] + t
        best[at] = lab[:k]
        if t:
            lab[:k] = back[at, before[:k], lab[:k]]


class Ragged:
    """Feature numbers of rows of different length."""

    def __init__(self, ptr: np.ndarray, idx: np.ndarray):
        self.ptr, self.idx = ptr, idx

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers of the rows, one after another; how many each has)."""
        size = self.ptr[rows + 1] - self.ptr[rows]
        end = np.cumsum(size)
        return self.idx[np.repeat(self.ptr[rows] - end + size, size) + np.arange(end[-1] if len(end) else 0)], size


@dataclass
class Crf:
    """Weights of hashed features (2**bits rows, row 0 always 0) and of neighbouring labels."""

    labels: list[str]
    bits: int
    weights: np.ndarray = field(default=None)
    trans: np.ndarray = field(default=None)
    squares: tuple = field(default=None, repr=False)

    def __post_init__(self) -> None:
        k = len(self.labels)
        if self.weights is None:
            self.weights, self.trans = np.zeros((1 << self.bits, k), np.float32), np.zeros((k, k), np.float32)

    def scores(self, feats: np.ndarray | Ragged) -> np.ndarray:
        """Scores of rows of feature numbers (of positions or of distinct words)."""
        if isinstance(feats, Ragged):
            out = np.zeros((len(feats), len(self.labels)))
            has = np.flatnonzero(np.diff(feats.ptr))
            if len(has):
                out[has] = np.add.reduceat(self.weights[feats.idx], feats.ptr[has], axis=0, dtype=np.float64)
            return out
        out = self.weights[feats[:, 0]].astype(np.float64)
        for j in range(1, feats.shape[1]):
            out += self.weights[feats[:, j]]
        return out

    def train(self, feats: np.ndarray | Ragged, gold: np.ndarray, ptr: np.ndarray, epochs: int = 4, batch: int = 256, rate: float = 0.3, decay: float = 1e-4, row: np.ndarray | None = None) -> None:
        """Gradient steps (AdaGrad, whose state goes on over calls) on the chains' log-likelihood, in batches of chains. row: each position's row of feats, if it is not its own."""
        k, rows = len(self.labels), 1 << self.bits
        if isinstance(feats, np.ndarray):
            feats = Ragged(np.arange(len(feats) + 1) * feats.shape[1], feats.ravel())
        row = np.arange(len(gold)) if row is None else row
        if self.squares is None:
            self.squares = np.full((rows, k), 1e-3, np.float32), np.full((k, k), 1e-3, np.float32)
        gw, gt = self.squares
        rng = np.random.default_rng(7)
        chains = np.flatnonzero(np.diff(ptr))
        for _ in range(epochs):
            rng.shuffle(chains)
            for i in range(0, len(chains), batch):
                own = chains[i : i + batch]
                size = ptr[own + 1] - ptr[own]
                p = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(ptr[own] - p[:-1], size) + np.arange(p[-1])
                y = gold[at]
                used, back = np.unique(row[at], return_inverse=True)
                idx, many = feats.take(used)
                s = self.scores(Ragged(np.concatenate([[0], np.cumsum(many)]), idx))[back]
                d, pairs = expectations(s, p, self.trans)
                d[np.arange(len(y)), y] -= 1
                # gradient of each distinct row, then of each feature
                dr = np.stack([np.bincount(back, d[:, c], minlength=len(used)) for c in range(k)], axis=1)
                uniq, inv = np.unique(idx, return_inverse=True)
                dr = np.repeat(dr, many, axis=0)
                g = np.stack([np.bincount(inv, dr[:, c], minlength=len(uniq)) for c in range(k)], axis=1) / len(own)
                g += decay * self.weights[uniq]
                gw[uniq] += g**2
                self.weights[uniq] -= rate * g / np.sqrt(gw[uniq])
                self.weights[0] = 0
                inner = np.ones(len(y), bool)
                inner[p[:-1]] = False
                b = np.flatnonzero(inner)
                g = (pairs - np.bincount(y[b - 1] * k + y[b], minlength=k * k).reshape(k, k)) / len(own) + decay * self.trans
                gt += g**2
                self.trans -= (rate * g / np.sqrt(gt)).astype(np.float32)
