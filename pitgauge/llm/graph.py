"""Connected components: of a table of edges by joins, of arrays by numpy."""

from __future__ import annotations

import numpy as np

from pitgauge.operators.components import connected_components  # noqa: F401


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new
