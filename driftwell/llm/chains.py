"""Viterbi decoding of many chains at once."""

from __future__ import annotations

import numpy as np


def viterbi(emit: list[np.ndarray], first: np.ndarray, steps: np.ndarray, cells: int = 200_000) -> list[np.ndarray]:
    """The likeliest states of each chain; ties go to the lower state.

    ``emit``: log scores (length, states) of each chain; ``first`` and ``steps``: of first states
    and of neighbouring ones. Chains of like length are decoded together, ``cells`` places at a time.
    """
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(emit)
    order = sorted((k for k in range(len(emit)) if len(emit[k])), key=lambda k: len(emit[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(emit[order[end]]) * (end - at + 1) <= cells:
            end += 1
        part = order[at:end]
        lengths = np.array([len(emit[k]) for k in part])
        n, t, s = len(part), int(lengths.max()), len(first)
        all_emit = np.zeros((n, t, s), np.float32)
        for k, i in enumerate(part):
            all_emit[k, : len(emit[i])] = emit[i]
        score, back = first + all_emit[:, 0], np.zeros((n, t, s), np.int8)
        for j in range(1, t):
            moves = score[:, :, None] + steps[None]
            back[:, j] = moves.argmax(1)
            score = np.where((j < lengths)[:, None], moves.max(1) + all_emit[:, j], score)
        path, last = np.zeros((n, t), np.int8), score.argmax(1)
        for j in range(t - 1, -1, -1):
            inside = j < lengths
            path[:, j] = np.where(inside, last, 0)
            last = np.where(inside & (j > 0), back[np.arange(n), j, last], last)
        for k, i in enumerate(part):
            out[i] = path[k, : lengths[k]]
        at = end
    return out


def best_steps(emit: np.ndarray, entry: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """(states, states): the best score of a way through all places, from each state before them to each state at the last.

    ``entry``: log scores from each state before the first place to each state at it.
    """
    best = entry + emit[0]
    for e in emit[1:]:
        best = (best[:, :, None] + steps[None]).max(1) + e
    return best


def best_between(emit: np.ndarray, first: np.ndarray, steps: np.ndarray, last: int) -> np.ndarray:
    """The likeliest states of one chain that ends in state ``last``; ties go to the lower state."""
    score, back = first + emit[0], np.zeros(emit.shape, np.int8)
    for j in range(1, len(emit)):
        moves = score[:, None] + steps
        back[j] = moves.argmax(0)
        score = moves.max(0) + emit[j]
    path = np.zeros(len(emit), np.int8)
    path[-1] = last
    for j in range(len(emit) - 1, 0, -1):
        path[j - 1] = back[j, path[j]]
    return path


def marginals(emit: np.ndarray, starts: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains of two states that lie in a row in ``emit``, each from its place in ``starts`` to the next.

    ``emit``: log score of state 1 over state 0 at each place. Returns the probability of state 1 at each place, that of
    each move from the place before (places, 2, 2; zero where a chain starts), and each chain's log normaliser.
    Places of all chains are worked out together, longest chains first.
    """
    n = len(emit)
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    at, falling = starts[order], -lengths[order]
    longest = int(lengths.max()) if len(lengths) else 0
    e, m = np.exp(np.clip(emit, -30, 30)), np.exp(steps)
    a, b, scale = np.empty((2, n)), np.ones((2, n)), np.ones(n)
    for j in range(longest):
        here = at[: np.searchsorted(falling, -j)] + j
        if j:
            p0, p1 = a[0, here - 1], a[1, here - 1]
            n0, n1 = p0 * m[0, 0] + p1 * m[1, 0], (p0 * m[0, 1] + p1 * m[1, 1]) * e[here]
        else:
            n0, n1 = np.full(len(here), np.exp(first[0])), np.exp(first[1]) * e[here]
        s = n0 + n1
        a[0, here], a[1, here], scale[here] = n0 / s, n1 / s, s
    for j in range(longest - 2, -1, -1):
        here = at[: np.searchsorted(falling, -j - 1)] + j
        u0, u1 = b[0, here + 1], e[here + 1] * b[1, here + 1]
        n0, n1 = m[0, 0] * u0 + m[0, 1] * u1, m[1, 0] * u0 + m[1, 1] * u1
        s = n0 + n1
        b[0, here], b[1, here] = n0 / s, n1 / s
    both = a * b
    moves = np.zeros((n, 2, 2))
    if n > 1:
        moves[1:] = a.T[:-1, :, None] * m[None] * (np.stack([b[0], e * b[1]], 1)[1:])[:, None, :]
        moves[starts] = 0
        total = moves.sum((1, 2), keepdims=True)
        moves /= np.where(total > 0, total, 1)
    logs = np.add.reduceat(np.log(scale), starts) if len(starts) else np.zeros(0)
    return both[1] / both.sum(0), moves, logs
