"""A linear-chain conditional random field with two labels, for whole chunks of chains at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Positions of a chain that are run through in step with those of all other chains.
SEGMENT = 64


class Transitions(NamedTuple):
    """Scores of label i followed by label j, as weights (exponentials)."""

    t00: float
    t01: float
    t10: float
    t11: float


def _segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains cut into segments: start and length of each, and the first segment of each chain."""
    lengths = np.diff(first)
    counts = -(-lengths // SEGMENT)
    head = np.concatenate([[0], np.cumsum(counts)])
    chain = np.repeat(np.arange(len(lengths)), counts)
    starts = first[:-1][chain] + (np.arange(head[-1]) - head[:-1][chain]) * SEGMENT
    return starts, np.minimum(SEGMENT, first[1:][chain] - starts), head


def _scan(gain: np.ndarray, first: np.ndarray, entry: float, t: Transitions) -> np.ndarray:
    """Odds x of label 1 after each position, where x' = gain * (t01 + t11 x) / (t00 + t10 x) and a chain begins with
    gain * ``entry``.

    The step is a 2 x 2 matrix on the odds, so a segment is a product of matrices. First the products of all segments
    are made in step, then the odds pass from segment to segment, then all segments are filled in step. A chain of n
    positions takes n / SEGMENT + 2 SEGMENT rounds and no rounding other than the usual.
    """
    starts, lengths, head = _segments(first)
    out = np.empty(len(gain))
    if not len(starts):
        return out
    leads = np.zeros(len(starts), bool)
    leads[head[:-1][np.diff(head) > 0]] = True
    order = np.argsort(-lengths, kind="stable")
    alive = np.searchsorted(-lengths[order], -np.arange(1, SEGMENT + 1), side="right")
    a, b, c, d = np.ones(len(starts)), np.zeros(len(starts)), np.zeros(len(starts)), np.ones(len(starts))
    for step in range(SEGMENT):
        if not (n := alive[step]):
            break
        at = order[:n]
        g = gain[starts[at] + step]
        if step == 0:  # a chain's first position has no transition into it
            at, g = at[~leads[at]], g[~leads[at]]
        na, nb = g * (t.t11 * a[at] + t.t01 * c[at]), g * (t.t11 * b[at] + t.t01 * d[at])
        nc, nd = t.t10 * a[at] + t.t00 * c[at], t.t10 * b[at] + t.t00 * d[at]
        scale = 1 / (na + nb + nc + nd)
        a[at], b[at], c[at], d[at] = na * scale, nb * scale, nc * scale, nd * scale
    before = np.empty(len(starts))
    counts = np.diff(head)
    chains = np.argsort(-counts, kind="stable")
    chains = chains[counts[chains] > 0]
    odds = gain[first[:-1][chains]] * entry
    for k in range(counts[chains[0]]):
        n = np.searchsorted(-counts[chains], -k, side="left")
        at = head[:-1][chains[:n]] + k
        before[at] = odds[:n]
        odds[:n] = (a[at] * odds[:n] + b[at]) / (c[at] * odds[:n] + d[at])
    for step in range(SEGMENT):
        if not (n := alive[step]):
            break
        at = order[:n]
        where = starts[at] + step
        x = gain[where] * (t.t01 + t.t11 * before[at]) / (t.t00 + t.t10 * before[at])
        if step == 0:
            x = np.where(leads[at], gain[where] * entry, x)
        before[at] = x
        out[where] = x
    return out


def odds(scores: np.ndarray, first: np.ndarray, t: Transitions) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of label 1 at each position of the chains ``first[d]`` to ``first[d + 1]``."""
    gain = np.exp(np.clip(scores, -30, 30))
    forward = _scan(gain, first, 1.0, t)
    # backwards, the message into a position has passed the one behind it: scan the reversed chains, then divide out
    turned = Transitions(t.t00, t.t10, t.t01, t.t11)
    lengths = np.diff(first)
    back = _scan(gain[::-1], len(gain) - first[::-1], 1.0, turned)[::-1]
    nxt = np.ones(len(gain))
    inner = np.ones(len(gain), bool)
    inner[first[1:][lengths > 0] - 1] = False
    behind = np.flatnonzero(inner)
    x = back[behind + 1]
    nxt[behind] = (t.t10 + t.t11 * x) / (t.t00 + t.t01 * x)
    return forward, nxt


def marginals(scores: np.ndarray, first: np.ndarray, t: Transitions) -> np.ndarray:
    """Probability of label 1 at each position, by forward-backward."""
    forward, backward = odds(scores, first, t)
    both = forward * backward
    return both / (1 + both)


def fit(add_scores, add_gradient, n_weights: int, labels: np.ndarray, first: np.ndarray, *, rounds: int = 60, rate: float = 0.2, decay: float = 1e-4, pull: float = 1.0):
    """Weights of the positions' scores and the transitions that make ``labels`` likely, by Adam on the whole sample.

    ``add_scores(weights)`` gives the scores, ``add_gradient(residual)`` the gradient of their weights. ``pull`` weighs
    positions of label 1 against those of label 0.
    """
    weights, steps = np.zeros(n_weights), np.zeros(4)
    moments = [np.zeros(n_weights + 4), np.zeros(n_weights + 4)]
    inner = np.ones(len(labels), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    pairs = np.bincount(labels[at - 1] * 2 + labels[at], minlength=4)
    for k in range(1, rounds + 1):
        t = Transitions(*np.exp(steps))
        scores = add_scores(weights)
        forward, backward = odds(scores, first, t)
        both = forward * backward
        residual = labels - both / (1 + both)
        residual = np.where(labels == 1, pull, 1.0) * residual
        left, right = forward[at - 1], np.exp(np.clip(scores[at], -30, 30)) * backward[at]
        cells = np.stack([np.full(len(at), t.t00), t.t01 * right, t.t10 * left, t.t11 * left * right])
        expected = (cells / cells.sum(axis=0)).sum(axis=1)
        gradient = np.concatenate([add_gradient(residual), pairs - expected]) / max(1, len(labels))
        gradient[:n_weights] -= decay * weights / max(1, len(labels)) ** 0.5
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        step = rate * (moments[0] / (1 - 0.9**k)) / (np.sqrt(moments[1] / (1 - 0.99**k)) + 1e-9)
        weights += step[:n_weights]
        steps = np.clip(steps + step[n_weights:] * 0.2, -4, 4)
        steps -= steps.mean()
    return weights, Transitions(*np.exp(steps))


def logistic(features: np.ndarray, labels: np.ndarray, *, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression, by Newton's method."""
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        w = w + np.linalg.solve(hessian, x.T @ (labels - p) - penalty @ w)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
