"""Minimum-cost matching of two small sides, by shortest augmenting paths."""

from __future__ import annotations

import numpy as np


def assign(costs: np.ndarray) -> tuple[list[int | None], list[int | None]]:
    """For a ``n x m`` cost matrix the partner of each row and of each column: min(n, m) pairs of least total cost."""
    n, m = costs.shape
    if n > m:
        columns, rows = assign(costs.T)
        return rows, columns
    # Sides are a few arguments long: lists, as an array's call takes longer than a row of it.
    cost, free = costs.tolist(), float("inf")
    row_of: list[int | None] = [None] * m
    u, v = [0.0] * n, [0.0] * m
    for new in range(n):
        # Dijkstra over columns with reduced costs, from the new row to a free column.
        reach, came, done = [free] * m, [-1] * m, [False] * m
        row, base, last = new, 0.0, -1
        while True:
            mine, lower = cost[row], u[row]
            near, nearest = -1, free
            for j in range(m):
                if not done[j]:
                    step = base + mine[j] - lower - v[j]
                    if step < reach[j]:
                        reach[j], came[j] = step, last
                    if near < 0 or reach[j] < nearest:
                        near, nearest = j, reach[j]
            last, base = near, nearest
            done[last] = True
            if row_of[last] is None:
                break
            row = row_of[last]
        for j in range(m):
            if done[j]:
                if row_of[j] is not None:
                    u[row_of[j]] += base - reach[j]
                v[j] -= base - reach[j]
        u[new] += base
        while last >= 0:
            before = came[last]
            row_of[last] = new if before < 0 else row_of[before]
            last = before
    column_of: list[int | None] = [None] * n
    for j, i in enumerate(row_of):
        if i is not None:
            column_of[i] = j
    return column_of, row_of
