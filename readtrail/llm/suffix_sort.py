"""Deep-shallow sorting of suffixes.

To a shallow depth suffixes are sorted as in multikey quicksort: groups that agree so far
are split by their next symbol (here of eight bytes), all groups at once.  Groups that
still agree then hold suffixes with long common prefixes, where comparing symbol by symbol
is wasteful: each is ordered by a blind trie, which descends on branching bits alone and
compares a suffix with one other only.
"""

from __future__ import annotations

import numpy as np

SYMBOL = 8


class _Leaf:
    __slots__ = ("value", "rows")

    def __init__(self, value: int, row: int) -> None:
        self.value, self.rows = value, [row]


class _Fork:
    __slots__ = ("bit", "sides")

    def __init__(self, bit: int, sides: list) -> None:
        self.bit, self.sides = bit, sides


def blind_trie_order(values: list[int]) -> list[int]:
    """Positions of equally long suffixes, given as big-endian integers, in ascending order."""
    root: _Leaf | _Fork = _Leaf(values[0], 0)
    for row in range(1, len(values)):
        value = values[row]
        node = root
        while type(node) is _Fork:
            node = node.sides[value >> node.bit & 1]
        differ = value ^ node.value
        if not differ:
            node.rows.append(row)
            continue
        bit = differ.bit_length() - 1
        above, node = None, root
        while type(node) is _Fork and node.bit > bit:
            above, side = node, value >> node.bit & 1
            node = node.sides[side]
        leaf = _Leaf(value, row)
        fork = _Fork(bit, [node, leaf] if value >> bit & 1 else [leaf, node])
        if above is None:
            root = fork
        else:
            above.sides[side] = fork
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if type(node) is _Fork:
            stack += node.sides[1], node.sides[0]
        else:
            out += node.rows
    return out


def deep_shallow_sort(suffixes: np.ndarray, sizes: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending order of zero-padded suffixes (rows of bytes) and common prefixes in that order.

    `shallow` is the depth in symbols; of equal padded rows the shorter comes first.  The
    common prefix of a row is that with the row before it (-1 for the first), within both sizes.
    """
    n, width = suffixes.shape
    symbols = -(-width // SYMBOL)
    padded = np.zeros((n, symbols * SYMBOL), np.uint8)
    padded[:, :width] = suffixes
    words = padded.view(">u8").astype(np.uint64)
    order = np.argsort(sizes, kind="stable")
    group = np.zeros(n, np.int64)
    for depth in range(min(shallow, symbols)):
        shared = np.bincount(group)[group] > 1
        at = np.flatnonzero(shared)
        if not len(at):
            break
        symbol = words[order[at], depth]
        turn = np.lexsort((symbol, group[at]))
        order[at] = order[at][turn]
        cut = np.zeros(n, bool)
        cut[1:] = group[1:] != group[:-1]
        symbol, own = symbol[turn], group[at]
        cut[at[1:]] |= (symbol[1:] != symbol[:-1]) | (own[1:] != own[:-1])
        group = np.cumsum(cut)
    if shallow < symbols:
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        ends = np.append(starts[1:], n)
        large = ends - starts > 1
        for lo, hi in zip(starts[large].tolist(), ends[large].tolist()):
            rows = order[lo:hi]
            values = [int.from_bytes(padded[r, shallow * SYMBOL:].tobytes(), "big") for r in rows]
            order[lo:hi] = rows[blind_trie_order(values)]
    common = np.full(n, -1, np.int64)
    for lo in range(1, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        differ = padded[order[lo:hi]] != padded[order[lo - 1:hi - 1]]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[lo:hi] = np.minimum(first, np.minimum(sizes[order[lo:hi]], sizes[order[lo - 1:hi - 1]]))
    return order, common
