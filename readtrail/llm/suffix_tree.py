"""Suffix trees of number sequences (Ukkonen), and longest common extensions from them."""

from __future__ import annotations

import numpy as np

END = -1  # closes a sequence; smaller than every symbol


class SuffixTree:
    """The tree of a sequence of symbols (0 and up), built from left to right in linear time.

    Nodes are numbers.  An edge into a node is the stretch `start[node]` to `end[node]` of
    the sequence; leaves end where the sequence does.
    """

    def __init__(self, symbols: list[int]) -> None:
        text = [*symbols, END]
        n = len(text)
        start, end, link, below = [0], [0], [0], [{}]
        node = edge = length = pending = 0  # the active point and the suffixes that wait
        for i, symbol in enumerate(text):
            pending += 1
            made = 0
            while pending:
                if not length:
                    edge = i
                first = text[edge]
                down = below[node].get(first)
                if down is None:
                    below[node][first] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    below.append(None)
                    if made:
                        link[made] = node
                    made = node
                else:
                    width = end[down] - start[down]
                    if length >= width:
                        edge += width
                        length -= width
                        node = down
                        continue
                    at = start[down] + length
                    if text[at] == symbol:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    fork = len(start)  # the edge splits: a node within it and a new leaf
                    below[node][first] = fork
                    start += (start[down], i)
                    end += (at, n)
                    link += (0, 0)
                    below += ({text[at]: down, symbol: fork + 1}, None)
                    start[down] = at
                    if made:
                        link[made] = fork
                    made = fork
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self.n, self.start, self.end, self.below = n, start, end, below

    def tour(self, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Leaves in the order of an Euler tour: their suffixes, and the depth of the lowest
        node passed between a leaf and the one before it (0 for the first).

        Children go by rising or falling symbol; the end comes first in both.
        """
        order, lowest = [], []
        start, end, below, n = self.start, self.end, self.below, self.n
        stack = [(0, 0)]
        passed = 0
        after_leaf = False
        while stack:
            node, above = stack.pop()
            if after_leaf:
                passed, after_leaf = above, False
            children = below[node]
            depth = above + end[node] - start[node]
            if children is None:
                order.append(n - depth)
                lowest.append(passed)
                after_leaf = True
                continue
            # pushed last is taken first
            keys = sorted(children, reverse=not falling)
            if falling and END in children:
                keys.remove(END)
                keys.append(END)
            stack.extend((children[k], depth) for k in keys)
        return np.array(order, np.int64), np.array(lowest, np.int64)


class Extensions:
    """Longest common prefixes of any two suffixes, in constant time each.

    The deepest common ancestor of two leaves is the lowest node that the tour passes
    between them: a range minimum, read from a table over power-of-two ranges.
    """

    def __init__(self, order: np.ndarray, lowest: np.ndarray) -> None:
        n = len(order)
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.table = [lowest.astype(np.int32)]
        while 2 << len(self.table) - 1 <= n:
            half = 1 << len(self.table) - 1
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at `a` and at `b`, which differ in every pair."""
        x, y = self.place[a], self.place[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            table = self.table[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return out
