"""CEAF-e: the one-to-one assignment of true to predicted clusters with the greatest sum of phi4."""

from __future__ import annotations

import numpy as np


def best_assignment(score: np.ndarray) -> float:
    """The greatest sum over one-to-one pairs of rows and columns (shortest augmenting paths with potentials)."""
    cost = -score if score.shape[0] <= score.shape[1] else -score.T
    rows, cols = cost.shape
    u, v = np.zeros(rows), np.zeros(cols)
    of_col = np.full(cols, -1)
    for start in range(rows):
        dist, done, back = np.full(cols, np.inf), np.zeros(cols, bool), np.full(cols, -1)
        row, reached, col = start, 0.0, -1
        while True:
            new = reached + cost[row] - u[row] - v
            better = ~done & (new < dist)
            dist[better], back[better] = new[better], col
            col_next = int(np.where(done, np.inf, dist).argmin())
            reached, done[col_next], col = dist[col_next], True, col_next
            if of_col[col] < 0:
                break
            row = of_col[col]
        settled = done & (np.arange(cols) != col)
        u[start] += reached
        u[of_col[settled]] += reached - dist[settled]
        v[settled] += dist[settled] - reached
        while col >= 0:
            before = back[col]
            of_col[col] = of_col[before] if before >= 0 else start
            col = before
    return float(sum(-cost[r, c] for c, r in enumerate(of_col) if r >= 0))
