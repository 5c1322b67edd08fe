"""Packed R-trees over count vectors, and the join of their rows with each other.

A row is a set: its members are counted per group, and the counts are its point.
Two sets share at most the sum of their points' coordinate minima; any two under
two nodes share at most the sum of minima of the nodes' upper corners. A row has
besides its size n a reach, the largest size that a partner may have; two rows
can be linked only if each one's size is within the other's reach. Nodes keep
their least size and largest reach, so whole subtrees are left out by these as well.

A forest has a tree for each of many groups and joins all of them at once: the
pairs of roots, then of their children that the bound leaves, down to rows. Only
connectivity is wanted, so what is connected already isn't compared: two nodes
whose rows are all in one part are left out whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAF, FAN = 16, 8
#: Pairs of rows, or of nodes, that are looked at together.
TOGETHER = 20_000


def need(a, b, percent: int):
    """The least overlap with which sets of a and b members are linked."""
    return -(-percent * (a + b) // (100 + percent))


def reach(n, rest, percent: int):
    """The largest size of a partner that shares at most ``rest`` members with a set of n."""
    return rest * (100 + percent) // percent - n


def merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (for each row the least one of its part) after connecting i with j."""
    root = root.copy()
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not ((after := root[root]) == root).all():
            root = after
    return root


def products(start_a: np.ndarray, size_a: np.ndarray, start_b: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of [start_a, start_a + size_a) with [start_b, start_b + size_b), for each entry; of one with itself the unordered ones and the diagonal."""
    many = size_a * size_b
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    width = np.repeat(size_b, many)
    i, j = np.repeat(start_a, many) + at // width, np.repeat(start_b, many) + at % width
    keep = (np.repeat(start_a, many) != np.repeat(start_b, many)) | (i <= j)
    return i[keep], j[keep]


class Forest:
    """Trees over the rows of each group. ``points`` are counts, a row's n is their sum."""

    def __init__(self, group: np.ndarray, points: np.ndarray, n: np.ndarray, reach: np.ndarray, percent: int):
        self.percent = percent
        # alike sets lie next to each other: by size within the percentage, then by a fixed direction
        band = np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent)).astype(np.int64)
        along = points @ np.random.default_rng(7).normal(size=points.shape[1]) / np.maximum(n, 1)
        self.order = np.lexsort((along, band, group))
        self.group, self.points, self.n, self.reach = group[self.order], points[self.order], n[self.order], reach[self.order]
        self.levels: list[dict[str, np.ndarray]] = []
        self._level(self.group, np.arange(len(group)), LEAF, self.points, self.n, self.reach)
        while len(np.unique(self.levels[-1]["group"])) < len(self.levels[-1]["group"]):
            x = self.levels[-1]
            self._level(x["group"], x["first"], FAN, x["corner"], x["n"], x["reach"])

    def _level(self, group, first, fan, corner, n, reach) -> None:
        """Nodes of ``fan`` neighbours of one group each."""
        begin = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
        place = np.arange(len(group)) - np.maximum.accumulate(np.where(begin, np.arange(len(group)), 0))
        start = np.flatnonzero(place % fan == 0)
        self.levels.append({
            "group": group[start], "child": start, "children": np.diff(np.r_[start, len(group)]), "first": first[start],
            "corner": np.maximum.reduceat(corner, start), "n": np.minimum.reduceat(n, start), "reach": np.maximum.reduceat(reach, start),
        })

    def _possible(self, i, j, corner, n, reach) -> np.ndarray:
        """Which pairs the sizes, and then the sum of coordinate minima, leave."""
        ok = (n[j] <= reach[i]) & (n[i] <= reach[j])
        left = np.flatnonzero(ok)
        for a in range(0, len(left), TOGETHER):
            some = left[a : a + TOGETHER]
            x, y = i[some], j[some]
            ok[some] = np.minimum(corner[x], corner[y]).sum(1) >= need(n[x], n[y], self.percent)
        return ok

    def _one_part(self, root: np.ndarray, level: dict[str, np.ndarray]) -> np.ndarray:
        """For each node the part that all its rows are in, or -1."""
        low, high = np.minimum.reduceat(root, level["first"]), np.maximum.reduceat(root, level["first"])
        return np.where(low == high, low, -1)

    def connect(self, test: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], skip: np.ndarray | None = None) -> np.ndarray:
        """For each row, as they were given, one row that names its part.

        ``test`` gets pairs of rows that the bound leaves, and the parts so far, and
        returns those that are linked. Rows of ``skip`` aren't compared with each other.
        """
        rows = len(self.order)
        if not rows:
            return np.zeros(0, np.int64)
        root = np.arange(rows)
        hidden = None if skip is None else skip[self.order]

        def rows_of(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal root
            keep = (i != j) & (root[i] != root[j])
            if hidden is not None:
                keep &= ~(hidden[i] & hidden[j])
            i, j = i[keep], j[keep]
            keep = self._possible(i, j, self.points, self.n, self.reach)
            i, j = i[keep], j[keep]
            if len(i):
                a, b = test(self.order[i], self.order[j], root[self.back])
                root = merged(root, self.back[a], self.back[b])

        def nodes(depth: int, i: np.ndarray, j: np.ndarray) -> None:
            level = self.levels[depth]
            # in runs of a bounded number of pairs below, so that a run's links spare the next one's
            below = level["children"][i] * level["children"][j]
            cut = np.flatnonzero(np.diff(np.r_[-1, (np.cumsum(below) - 1) // TOGETHER]))
            for a, b in zip(cut, np.r_[cut[1:], len(i)], strict=True):
                x, y = i[a:b], j[a:b]
                part = self._one_part(root, level)
                keep = (part[x] < 0) | (part[x] != part[y])
                x, y = x[keep], y[keep]
                keep = self._possible(x, y, level["corner"], level["n"], level["reach"])
                x, y = x[keep], y[keep]
                if not len(x):
                    continue
                pairs = products(level["child"][x], level["children"][x], level["child"][y], level["children"][y])
                if depth:
                    nodes(depth - 1, *pairs)
                else:
                    rows_of(*pairs)

        self.back = np.empty(rows, np.int64)
        self.back[self.order] = np.arange(rows)
        top = np.arange(len(self.levels[-1]["group"]))
        nodes(len(self.levels) - 1, top, top)
        return self.order[root][self.back]
