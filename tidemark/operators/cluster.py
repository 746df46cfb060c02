"""Average-linkage clustering of a short list of assets by correlation distance, on the driver."""

from __future__ import annotations

import numpy as np


def distances(correlation: np.ndarray) -> np.ndarray:
    """Distances sqrt((1 - rho) / 2), rho clipped to [-1, 1], the diagonal 0."""
    d = np.sqrt(0.5 * (1.0 - np.clip(correlation, -1.0, 1.0)))
    np.fill_diagonal(d, 0.0)
    return d


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float, int]]:
    """UPGMA merges ``(left id, right id, distance, size)``; new clusters are numbered on from the leaves.

    The nearest pair is merged, ties by the lower ids. Distances to a merged cluster follow from its parts' by their sizes
    (Lance-Williams), so a merge costs one row of the matrix.
    """
    n = len(distance)
    ids, size = list(range(n)), np.ones(n)
    d = distance.astype(float).copy()
    merges = []
    for step in range(n - 1):
        order = np.argsort(ids, kind="stable")
        view = d[np.ix_(order, order)]
        rows, cols = np.triu_indices(len(ids), 1)
        at = int(np.lexsort((cols, rows, np.round(view[rows, cols], 14)))[0])
        i, j = int(order[rows[at]]), int(order[cols[at]])
        merges.append((ids[i], ids[j], float(d[i, j]), int(size[i] + size[j])))
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = 0.0
        size[i] += size[j]
        ids[i] = n + step
        keep = [k for k in range(len(ids)) if k != j]
        d, size, ids = d[np.ix_(keep, keep)], size[keep], [ids[k] for k in keep]
    return merges


def members(merges: list[tuple[int, int, float, int]], labels: list[str]) -> list[list[str]]:
    """The labels in each merged cluster, in leaf order."""
    held: list[list[str]] = [[x] for x in labels]
    for left, right, *_ in merges:
        held.append(held[left] + held[right])
    return held[len(labels) :]
