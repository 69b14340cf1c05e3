"""Cheapest edit audits of a conversation, by dynamic programming over shared prefixes.

States are what the repaired conversation ends with so far: nothing, a system turn, a user
turn, an assistant turn.  An audit is a string of edits; one is kept per state, the cheapest
and, among those, the least.  Audits share their beginnings as linked nodes.  Each node
knows its ancestors 1, 2, 4, … steps back and a rolling hash of its whole string, so two
audits of one cost are compared by searching for the end of their common prefix; prefixes
that only agree by hash are told apart.

Inserts go directly before the turn that follows, or to the very end.  Every audit of the
same turns then holds as many K, R and D, and ends with one, so none is the beginning of
another, and the least beginnings make up the least whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

START, SYSTEM, USER, ASSISTANT = range(4)
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3  # faults of a turn
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}

_INSERTED = {  # state: states within reach by inserts, and how many those take
    START: {START: 0, USER: 1, ASSISTANT: 2}, SYSTEM: {SYSTEM: 0, USER: 1, ASSISTANT: 2},
    USER: {USER: 0, ASSISTANT: 1}, ASSISTANT: {ASSISTANT: 0, USER: 1},
}
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}


def _moves(initial: str) -> tuple[list[tuple], list[tuple]]:
    """Moves (from, to, edits, cost) over a turn that may stay, and over one that must go."""
    gone = [(s, s, "D", COSTS["D"]) for s in _INSERTED]  # inserts after a D come before the next turn
    stay = []
    for s, reached in _INSERTED.items():
        for middle, n in reached.items():
            for edit, letters in (("K", initial), ("R", "ua")):
                for letter in letters:
                    t = _NEXT.get((middle, letter))
                    if t is not None and not (edit == "R" and letter == initial):  # keeping is cheaper
                        stay.append((s, t, "I" * n + edit, COSTS[edit] + n * COSTS["I"]))
    return stay, gone


MOVES = {c: _moves(c) for c in "sua?"}
FINISH = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


class Audits:
    """A forest of strings that share prefixes; node 0 is the empty string."""

    def __init__(self, modulus: int = (1 << 61) - 1) -> None:
        self.modulus = modulus
        self.piece: list[str] = [""]
        self.depth, self.hash = [0], [0]
        self.back: list[list[int]] = [[]]
        self.same: set[tuple[int, int]] = set()

    def add(self, node: int, piece: str) -> int:
        back, k = [node], 0
        while len(self.back[back[k]]) > k:
            back.append(self.back[back[k]][k])
            k += 1
        self.back.append(back)
        self.piece.append(piece)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * 1_000_003 + zlib.crc32(piece.encode()) + 1) % self.modulus)
        return len(self.piece) - 1

    def extend(self, node: int, pieces: Iterable[str]) -> int:
        for piece in pieces:
            node = self.add(node, piece)
        return node

    def _lifted(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.back[node][k]
            steps >>= 1
            k += 1
        return node

    def _first_difference(self, a: int, b: int) -> tuple[str, str] | None:
        """The first pieces that differ in two strings of one length, from a walk to where they join."""
        walked, found = [], None
        while a != b and (a, b) not in self.same:
            if self.piece[a] != self.piece[b]:
                found = self.piece[a], self.piece[b]
            walked.append((a, b))
            a, b = self.back[a][0], self.back[b][0]
        if found is None:
            self.same.update(walked[:1])
        return found

    def less(self, x: int, y: int) -> bool:
        depth = min(self.depth[x], self.depth[y])
        a, b = self._lifted(x, self.depth[x] - depth), self._lifted(y, self.depth[y] - depth)
        if self.hash[a] == self.hash[b]:
            differ = self._first_difference(a, b)
            return differ[0] < differ[1] if differ else self.depth[x] < self.depth[y]
        for k in range(len(self.back[a]) - 1, -1, -1):
            if k < len(self.back[a]):
                p, q = self.back[a][k], self.back[b][k]
                if self.hash[p] != self.hash[q]:
                    a, b = p, q
        differ = self._first_difference(self.back[a][0], self.back[b][0]) or (self.piece[a], self.piece[b])
        return differ[0] < differ[1]

    def least(self, nodes: list[int]) -> int:
        best = nodes[0]
        for node in nodes[1:]:
            if self.less(node, best):
                best = node
        return best

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.piece[node])
            node = self.back[node][0]
        return "".join(reversed(out))


Best = dict[int, tuple[int, int]]  # state: cost, audit


def _settled(audits: Audits, offers: dict[int, list[tuple]]) -> Best:
    """Per state the cheapest offer (cost, audit, pieces to add), the least of equal ones."""
    best = {}
    for state, offered in offers.items():
        cost = min(o[0] for o in offered)
        best[state] = cost, audits.least([audits.extend(node, more) for c, node, more in offered if c == cost])
    return best


def over_turns(turns: list[tuple[str, int]], state: int, modulus: int | None = None) -> dict[int, tuple[int, str]]:
    """Per end state the cost and audit of the turns (initial, fault), begun in `state`."""
    audits = Audits(modulus) if modulus else Audits()
    best: Best = {state: (0, 0)}
    for initial, fault in turns:
        stay, gone = MOVES.get(initial) or MOVES["?"]
        offers: dict[int, list[tuple]] = {}
        if fault != BLANK and fault != DUPLICATE:
            extra = fault == TRUNCATED
            for s, t, edits, cost in stay:
                if s in best:
                    offers.setdefault(t, []).append((best[s][0] + cost + extra, best[s][1], edits))
        for s, t, edits, cost in gone:
            if s in best:
                offers.setdefault(t, []).append((best[s][0] + cost, best[s][1], edits))
        best = _settled(audits, offers)
    return {s: (cost, audits.text(node)) for s, (cost, node) in best.items()}


def over_blocks(blocks: list[dict[int, dict[int, tuple[int, str]]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from its blocks, each {state before: :func:`over_turns`}."""
    audits = Audits()
    best: Best = {START: (0, 0)}
    for block in blocks:
        offers: dict[int, list[tuple]] = {}
        for s, (cost, node) in best.items():
            for t, (more, audit) in block[s].items():
                offers.setdefault(t, []).append((cost + more, node, (audit,)))
        best = _settled(audits, offers)
    ends = [(cost + COSTS["I"] * len(FINISH[s]), node, FINISH[s]) for s, (cost, node) in best.items()]
    cost, node = _settled(audits, {START: ends})[START]
    return cost, audits.text(node)
