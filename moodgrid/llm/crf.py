"""Linear-chain conditional random field with two states (clean, toxic).

A sequence is one sentence; a token is a vocabulary index, 0 for any
token outside the vocabulary.  Potentials of the toxic state against the
clean one: a weight for the token, one for its left and one for its right
neighbour, and a bias; transitions have three free weights.  Sequences of
one batch are processed position by position, longest first, so a step
touches only the sequences that are still going.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Weights(NamedTuple):
    """``token`` is (vocabulary, 3): own, left and right; entry 0 stays 0.
    ``move[a, b]`` scores state a followed by b; clean to clean is 0."""
    token: np.ndarray
    bias: float
    move: np.ndarray


class Batch:
    """Sequences laid out position by position.

    ``order`` sorts by falling length; ``live[t]`` sequences have a
    position t; cell (t, i) lies at ``base[t] + i``.
    """

    def __init__(self, tokens: np.ndarray, size: np.ndarray):
        self.size = size
        self.order = np.argsort(-size, kind="stable")
        sorted_size = size[self.order]
        longest = int(sorted_size[0]) if len(size) else 0
        self.live = np.searchsorted(-sorted_size, -np.arange(longest), side="left")
        self.base = np.concatenate([[0], np.cumsum(self.live)])
        rank = np.empty(len(size), np.int64)
        rank[self.order] = np.arange(len(size))
        first = np.cumsum(size) - size
        within = np.arange(len(tokens)) - np.repeat(first, size)
        self.cell = self.base[within] + np.repeat(rank, size)  # of every token in input order
        left, right = np.zeros_like(tokens), np.zeros_like(tokens)
        left[1:], right[:-1] = tokens[:-1], tokens[1:]
        left[first[size > 0]] = 0
        right[(first + size - 1)[size > 0]] = 0
        self.tokens = np.stack([tokens, left, right])

    def node(self, w: Weights) -> np.ndarray:
        s = w.token[self.tokens[0], 0] + w.token[self.tokens[1], 1] + w.token[self.tokens[2], 2] + w.bias
        out = np.empty(len(s))
        out[self.cell] = s
        return out


def marginals(b: Batch, w: Weights):
    """(probability of the toxic state per token in input order, log Z per
    sequence, the forward and backward scores behind them)."""
    node = b.node(w)
    steps, live, base = len(b.live), b.live, b.base
    alpha, beta = np.zeros((len(node), 2)), np.zeros((len(node), 2))
    for t in range(steps):
        here = slice(base[t], base[t + 1])
        if t == 0:
            a = np.zeros((live[0], 2))
        else:
            p = alpha[base[t - 1]:base[t - 1] + live[t]]
            a = np.stack([np.logaddexp(p[:, 0] + w.move[0, 0], p[:, 1] + w.move[1, 0]),
                          np.logaddexp(p[:, 0] + w.move[0, 1], p[:, 1] + w.move[1, 1])], axis=1)
        a[:, 1] += node[here]
        alpha[here] = a
    for t in range(steps - 2, -1, -1):
        n = live[t + 1]
        q = beta[base[t + 1]:base[t + 1] + n].copy()
        q[:, 1] += node[base[t + 1]:base[t + 1] + n]
        beta[base[t]:base[t] + n, 0] = np.logaddexp(w.move[0, 0] + q[:, 0], w.move[0, 1] + q[:, 1])
        beta[base[t]:base[t] + n, 1] = np.logaddexp(w.move[1, 0] + q[:, 0], w.move[1, 1] + q[:, 1])
    both = alpha + beta
    log_z = np.logaddexp(both[:, 0], both[:, 1])
    toxic = np.exp(both[:, 1] - log_z)
    z = np.zeros(len(b.size))
    z[b.order[:live[0] if steps else 0]] = log_z[:live[0]] if steps else 0
    return toxic[b.cell], z, (alpha, beta, node, log_z)


def any_toxic(b: Batch, w: Weights, log_z: np.ndarray) -> np.ndarray:
    """Probability that a sequence has a toxic token: 1 - P(all clean)."""
    clean = w.move[0, 0] * np.maximum(b.size - 1, 0)
    return np.where(b.size > 0, -np.expm1(np.minimum(0.0, clean - log_z)), 0.0)


def fit(tokens: np.ndarray, size: np.ndarray, labels: np.ndarray, weight: np.ndarray, vocabulary: int,
        rounds: int = 150, rate: float = 0.15, penalty: float = 0.1) -> Weights:
    """Weights of highest penalised likelihood by Adam on the full batch.

    ``weight`` counts how often each sequence occurs.
    """
    b = Batch(tokens, size)
    per_token = np.repeat(weight, size)
    first = np.cumsum(size) - size
    inner = np.ones(len(tokens), bool)
    inner[first[size > 0]] = False
    pairs = np.flatnonzero(inner)  # tokens with one before them
    seen_move = np.zeros((2, 2))
    np.add.at(seen_move, (labels[pairs - 1], labels[pairs]), per_token[pairs])
    theta = np.zeros(vocabulary * 3 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def unpack(x: np.ndarray) -> Weights:
        token = x[:vocabulary * 3].reshape(vocabulary, 3).copy()
        token[0] = 0
        move = np.zeros((2, 2))
        move[0, 1], move[1, 0], move[1, 1] = x[-3:]
        return Weights(token, float(x[-4]), move)

    for k in range(1, rounds + 1):
        w = unpack(theta)
        p, _, (alpha, beta, node, log_z) = marginals(b, w)
        gap = (labels - p) * per_token
        g = np.zeros_like(theta)
        own = g[:vocabulary * 3].reshape(vocabulary, 3)
        for side in range(3):
            own[:, side] = np.bincount(b.tokens[side], weights=gap, minlength=vocabulary)
        own[0] = 0
        g[-4] = gap.sum()
        at, to = b.cell[pairs - 1], b.cell[pairs]
        for i, (x, y) in enumerate(((0, 1), (1, 0), (1, 1))):
            joint = np.exp(alpha[at, x] + w.move[x, y] + beta[to, y] + y * node[to] - log_z[to])
            g[-3 + i] = seen_move[x, y] - (joint * per_token[pairs]).sum()
        g -= penalty * theta
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return unpack(theta)
