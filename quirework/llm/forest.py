"""Union-find over the rows of one task."""

from __future__ import annotations

import numpy as np


class Forest:
    """Union-find over positions; keeps the links that joined two groups."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def roots(self) -> np.ndarray:
        while True:
            above = self.parent[self.parent]
            if np.array_equal(above, self.parent):
                return above
            self.parent = above

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        roots = self.roots()
        new = roots[a] != roots[b]
        for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((i, j))
