"""Flat neighbour-array graphs over vectors: robust pruning and batched best-first search.

A graph is one integer array, a row of neighbour indices for each vector (-1: none). All steps are
vectorised over a block of vectors or queries.
"""

from __future__ import annotations

import numpy as np


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest(d: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k least entries of each row, least first."""
    k = min(k, d.shape[1])
    part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(k), (len(d), 1))
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)


def robust_prune(x: np.ndarray, at: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each vector ``at`` the candidates (a row of indices, -1: none) that no kept, nearer candidate covers:
    c goes if alpha * d(kept, c) <= d(at, c)."""
    n = len(cand)
    order = np.argsort(cand, axis=1, kind="stable")
    cand = np.take_along_axis(cand, order, 1)
    own = x[np.maximum(cand, 0)]
    # All distances among a vector's candidates at once, by inner products.
    size = (own * own).sum(-1)
    among = size[:, :, None] + size[:, None, :] - 2 * own @ own.transpose(0, 2, 1)
    d = size + (x[at] * x[at]).sum(1)[:, None] - 2 * (own @ x[at][:, :, None])[..., 0]
    among, d = alpha * np.sqrt(np.maximum(among, 0)), np.sqrt(np.maximum(d, 0))
    d[(cand < 0) | (cand == at[:, None])] = np.inf
    d[:, 1:][cand[:, 1:] == cand[:, :-1]] = np.inf
    out = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    left = d.copy()
    for k in range(degree):
        first = left.argmin(axis=1)
        some = np.isfinite(left[rows, first])
        if not some.any():
            break
        out[some, k] = cand[rows[some], first[some]]
        left[rows, first] = np.inf
        left[some[:, None] & (among[rows, first] <= d)] = np.inf
    return out


def reverse_edges(nbrs: np.ndarray, most: int) -> np.ndarray:
    """For each vector up to ``most`` vectors that have it as neighbour."""
    n, width = nbrs.shape
    to, by = nbrs.ravel(), np.repeat(np.arange(n), width)
    to, by = to[nbrs.ravel() >= 0], by[nbrs.ravel() >= 0]
    order = np.argsort(to, kind="stable")
    to, by = to[order], by[order]
    rank = np.arange(len(to)) - np.searchsorted(to, to)
    out = np.full((n, most), -1, np.int64)
    ok = rank < most
    out[to[ok], rank[ok]] = by[ok]
    return out


def search(x: np.ndarray, nbrs: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, rounds: int = 200, visited_out: bool = False):
    """Best-first search of all queries at once: (indices, squared distances) of the ``beam`` nearest
    found, least first. ``entry``: a row of start indices for each query."""
    m, n = len(q), len(x)
    seen = np.zeros((m, n), bool)
    rows = np.arange(m)

    def measure(idx):
        d = ((x[np.maximum(idx, 0)] - q[:, None]) ** 2).sum(-1)
        bad = idx < 0
        bad |= seen[rows[:, None], np.maximum(idx, 0)]
        order = np.argsort(idx, axis=1, kind="stable")
        s = np.take_along_axis(idx, order, 1)
        dup = np.zeros_like(bad)
        dup[:, 1:] = s[:, 1:] == s[:, :-1]
        np.put_along_axis(bad, order, np.take_along_axis(bad, order, 1) | dup, 1)
        d[bad] = np.inf
        ok = ~bad
        seen[np.broadcast_to(rows[:, None], idx.shape)[ok], idx[ok]] = True
        return d

    pool = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf)
    open_ = np.zeros((m, beam), bool)

    def merge(idx, d):
        nonlocal pool, dist, open_
        a = np.concatenate([pool, idx], 1)
        b = np.concatenate([dist, d], 1)
        c = np.concatenate([open_, np.isfinite(d)], 1)
        by = nearest(b, beam)
        pool, dist, open_ = np.take_along_axis(a, by, 1), np.take_along_axis(b, by, 1), np.take_along_axis(c, by, 1)

    merge(entry, measure(entry))
    for _ in range(rounds):
        some = open_.any(axis=1)
        if not some.any():
            break
        # Expand the two nearest open entries of each query.
        idx = np.full((m, 0), -1, np.int64)
        for _ in range(2):
            first = open_.argmax(axis=1)
            has = open_[rows, first]
            open_[rows, first] = False
            got = np.where(has[:, None], nbrs[pool[rows, first]], -1)
            idx = np.concatenate([idx, got], 1)
        merge(idx, measure(idx))
    return pool, dist
