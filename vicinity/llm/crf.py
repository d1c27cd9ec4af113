"""Linear-chain conditional random fields of two states, in numpy."""

from __future__ import annotations

import math

import numpy as np


def chain_marginals(u: np.ndarray, first: np.ndarray, trans: np.ndarray, seg: int = 32) -> np.ndarray:
    """P(state 1) of every token, from forward-backward over each text's tokens. u: log potentials of state 1 against state 0."""
    return _forward_backward(u, first, trans, seg, False)[0]


def chain_expectations(u: np.ndarray, first: np.ndarray, trans: np.ndarray, seg: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """chain_marginals, and the expected number of each pair of neighbouring states."""
    return _forward_backward(u, first, trans, seg, True)


def _forward_backward(u: np.ndarray, first: np.ndarray, trans: np.ndarray, seg: int, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected pairs.

    u: log potentials of state 1 against state 0. All texts form one chain in
    which a text's first step forgets the state before it. Segments of it are
    multiplied side by side, so each step is one operation over all segments.
    """
    n = len(u)
    both = np.zeros((2, 2))
    if not n:
        return np.zeros(0), both
    pad = -n % seg
    s = (n + pad) // seg
    one = np.exp(np.clip(np.concatenate([u, np.zeros(pad)]), -30, 30)).reshape(s, seg)
    begins = np.zeros(n + pad, bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    begins[n:] = True
    begins = begins.reshape(s, seg)
    t = np.exp(trans)
    m = np.empty((seg, s, 2, 2))  # m[k, :, i, j]: from state i before to state j at step k
    for k in range(seg):
        for i in (0, 1):
            m[k, :, i, 0] = np.where(begins[:, k], 1.0, t[i, 0])
            m[k, :, i, 1] = np.where(begins[:, k], 1.0, t[i, 1]) * one[:, k]
    whole = m[0]
    for k in range(1, seg):
        whole = whole @ m[k]
        whole /= whole.sum((1, 2), keepdims=True)
    fore, back = np.empty((s, 2)), np.empty((s, 2))
    v = (0.5, 0.5)
    w = whole.tolist()
    for x in range(s):
        fore[x] = v
        (a, b), (c, d) = w[x]
        p, q = v[0] * a + v[1] * c, v[0] * b + v[1] * d
        v = (p / (p + q), q / (p + q))
    v = (0.5, 0.5)
    for x in range(s - 1, -1, -1):
        back[x] = v
        (a, b), (c, d) = w[x]
        p, q = a * v[0] + b * v[1], c * v[0] + d * v[1]
        v = (p / (p + q), q / (p + q))
    alpha = np.empty((seg, s, 2))
    f = fore
    for k in range(seg):
        f = np.stack([f[:, 0] * m[k, :, 0, 0] + f[:, 1] * m[k, :, 1, 0], f[:, 0] * m[k, :, 0, 1] + f[:, 1] * m[k, :, 1, 1]], 1)
        f /= f.sum(1, keepdims=True)
        alpha[k] = f
    out, b = np.empty((seg, s)), back
    for k in range(seg - 1, -1, -1):
        x = alpha[k] * b
        out[k] = x[:, 1] / x.sum(1)
        if pairs:
            f = alpha[k - 1] if k else fore
            joint = f[:, :, None] * m[k] * b[:, None, :]
            inner = ~begins[:, k]
            both += (joint[inner] / joint[inner].sum((1, 2), keepdims=True)).sum(0)
        b = np.stack([m[k, :, 0, 0] * b[:, 0] + m[k, :, 0, 1] * b[:, 1], m[k, :, 1, 0] * b[:, 0] + m[k, :, 1, 1] * b[:, 1]], 1)
        b /= b.sum(1, keepdims=True)
    return out.T.reshape(-1)[:n], both


def best_path(u: list[float], trans: np.ndarray) -> list[int]:
    """Viterbi: the likeliest states of one sequence; ties go to state 0."""
    (t00, t01), (t10, t11) = trans.tolist()
    a, b, back = 0.0, 0.0, []
    for i, x in enumerate(u):
        if i:
            from_a, from_b = a >= b + t10 - t00, a + t01 >= b + t11
            a, b = (a + t00 if from_a else b + t10), (a + t01 if from_b else b + t11)
            back.append((0 if from_a else 1, 0 if from_b else 1))
        b += x
    state = int(b > a)
    path = [state]
    for step in reversed(back):
        state = step[state]
        path.append(state)
    return path[::-1] if u else []


def fit_chain(features: list[list[int]], labels: np.ndarray, first: np.ndarray, size: int, rounds: int = 150, ridge: float = 0.02, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transitions by gradient ascent (Adam) on the penalised log likelihood."""
    at = np.repeat(np.arange(len(features)), [len(f) for f in features])
    k = np.array([x for f in features for x in f], np.int64)
    n = len(features)
    z = labels.astype(float)
    begins = np.zeros(n, bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    inner = np.flatnonzero(~begins)
    gold = np.zeros((2, 2))
    np.add.at(gold, (labels[inner - 1], labels[inner]), 1)
    w, trans = np.zeros(size), np.zeros((2, 2))
    m = [np.zeros(size), np.zeros((2, 2))]
    v = [np.zeros(size), np.zeros((2, 2))]
    for it in range(1, rounds + 1):
        p, both = chain_expectations(np.bincount(at, w[k], minlength=n), first, trans)
        g_w = np.bincount(k, (z - p)[at], minlength=size) / n - ridge / 100 * w
        for i, g in enumerate((g_w, (gold - both) / n - ridge / 10 * trans)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            d = rate * (m[i] / (1 - 0.9**it)) / (np.sqrt(v[i] / (1 - 0.99**it)) + 1e-8)
            if i:
                trans = trans + d
            else:
                w = w + d
    assert math.isfinite(float(np.abs(w).max(initial=0.0)))
    return w, trans
