"""Tree edit distance between ordered forests, with the mapping that attains it.

Unit costs to insert and delete; a change of a node costs what change_cost() says. The distance follows
keyroots over postorder numbers; the mapping is traced back, deletions before insertions before matches where they cost the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from palimpsest.functions import languages as L

INSERT = DELETE = UPDATE = 1
MOVE = 0
LITERAL_UPDATE = 2
FORBIDDEN = 3


class Forest:
    """Nodes in postorder with their leftmost leaves, under a root of their own (the last)."""

    def __init__(self, roots: Sequence[int], children: Callable[[int], Sequence[int]]):
        self.node: list[int] = []
        self.left: list[int] = []
        firsts: dict[int, int] = {}
        stack: list[tuple[int, bool]] = [(r, False) for r in reversed(roots)]
        while stack:
            x, done = stack.pop()
            if done:
                self.left.append(firsts[x])
                self.node.append(x)
                continue
            firsts[x] = len(self.node)
            stack.append((x, True))
            stack += [(c, False) for c in reversed(children(x))]
        self.node.append(-1)
        self.left.append(0)
        last: dict[int, int] = {}
        for i, l in enumerate(self.left):
            last[l] = i
        self.keyroots = sorted(last.values())


def distance(a: Forest, b: Forest, change: Callable[[int, int], float]) -> tuple[float, list[tuple[int, int]]]:
    """Distance of two forests and the pairs of nodes that are mapped to each other."""
    n, m = len(a.node), len(b.node)
    cost = np.full((n, m), 1e9)
    for i in range(n - 1):
        cost[i, : m - 1] = [change(a.node[i], y) for y in b.node[:-1]]
    cost[n - 1, m - 1] = 0  # the forests' own roots only match each other
    tree = np.zeros((n, m))
    left = np.array(b.left)

    def forest(i: int, j: int) -> np.ndarray:
        """Distances of all prefixes of two subtrees, a row at a time: insertions, which chain along a row, are a running minimum."""
        li, lj = a.left[i], b.left[j]
        f = np.zeros((i - li + 2, j - lj + 2))
        f[:, 0], f[0, :] = np.arange(len(f)), np.arange(f.shape[1])
        along = np.arange(f.shape[1]) * INSERT
        back = left[lj : j + 1] - lj
        whole_y = np.flatnonzero(back == 0)
        for x in range(li, i + 1):
            row, above = f[x - li + 1], f[x - li]
            best = f[a.left[x] - li][back] + tree[x, lj : j + 1]
            if whole_x := a.left[x] == li:
                best[whole_y] = above[whole_y] + cost[x, lj + whole_y]
            row[1:] = np.minimum(above[1:] + DELETE, best)
            row[:] = np.minimum.accumulate(row - along) + along
            if whole_x:
                tree[x, lj + whole_y] = row[1 + whole_y]
        return f

    # a leaf against a subtree needs no table: it is put in, or stands for the node of the subtree that it costs least to change
    alone = lambda x: np.array([i for i in x.keyroots if x.left[i] == i and x.node[i] >= 0], int)
    single_a, single_b = alone(a), alone(b)
    for x in range(n):
        tree[x, single_b] = x - a.left[x] + np.minimum(cost[a.left[x] : x + 1, single_b].min(0), DELETE + INSERT) if len(single_b) else 0
    for y in range(m):
        tree[single_a, y] = y - b.left[y] + np.minimum(cost[single_a, b.left[y] : y + 1].min(1), DELETE + INSERT) if len(single_a) else 0
    lone_a, lone_b = set(single_a.tolist()), set(single_b.tolist())
    for i in (i for i in a.keyroots if i not in lone_a):
        for j in (j for j in b.keyroots if j not in lone_b):
            forest(i, j)
    pairs: list[tuple[int, int]] = []
    todo = [(n - 1, m - 1)]
    while todo:
        i, j = todo.pop()
        f = forest(i, j)
        li, lj = a.left[i], b.left[j]
        x, y = i, j
        while x >= li or y >= lj:
            p, q = x - li + 1, y - lj + 1
            if x >= li and f[p, q] == f[p - 1, q] + DELETE:
                x -= 1
            elif y >= lj and f[p, q] == f[p, q - 1] + INSERT:
                y -= 1
            elif a.left[x] == li and b.left[y] == lj:
                if a.node[x] >= 0 and b.node[y] >= 0:
                    pairs.append((a.node[x], b.node[y]))
                x, y = x - 1, y - 1
            else:
                todo.append((x, y))
                x, y = a.left[x] - 1, b.left[y] - 1
    return float(tree[n - 1, m - 1]), pairs


def change_cost(kind_a: str, kind_b: str, text_a: str | None, text_b: str | None, language: str) -> float:
    """0 for equal leaves and for inner nodes of one kind, 2 for literals, 1 for other leaves and kinds that may stand for each other, else 3. Texts are None for inner nodes."""
    if kind_a == kind_b:
        if text_a is None or text_b is None:
            return 0 if text_a is text_b else FORBIDDEN
        return 0 if text_a == text_b else LITERAL_UPDATE if kind_a in L.LITERALS else UPDATE
    if (text_a is None) == (text_b is None) and compatible(kind_a, kind_b, language):
        return UPDATE
    return FORBIDDEN


def compatible(kind_a: str, kind_b: str, language: str) -> bool:
    if kind_a == kind_b or (kind_a in L.IDENTIFIERS and kind_b in L.IDENTIFIERS):
        return True
    return any(kind_a in f and kind_b in f for f in L.OPERATOR_FAMILIES.get(language, ()))
