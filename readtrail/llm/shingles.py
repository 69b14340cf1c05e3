"""Word shingles of texts, and bit sketches that bound how much two sets of them differ.

A bit sketch toggles one bit for each element of a set.  What two sets share cancels out, so
their sketches differ in no more bits than the sets do in elements: pairs whose sketches
differ more than linked sets may are no links, without any chance of error.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import xxhash

from readtrail.llm.common import mix64, per_worker
from readtrail.llm.linking import Likeness, Sketches

SHINGLE = 4
_GOLD = 0x9E3779B97F4A7C15


def word_list(text: str) -> list[bytes]:
    """Words, A to Z lowered and nothing else: bytes know no other letters or blanks."""
    return text.encode().lower().split()


class Shingler:
    def __init__(self, shingle: int = SHINGLE) -> None:
        self.shingle = shingle
        self.factors = mix64(np.arange(1, shingle + 1, dtype=np.uint64) * np.uint64(_GOLD)) | np.uint64(1)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Sorted hashes of the distinct shingles; fewer words than one shingle are one together."""
        if not words:
            return np.zeros(0, np.uint64)
        n = len(words) - self.shingle + 1
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        if n < 1:
            n, h = 1, np.append(h, np.zeros(self.shingle - len(words), np.uint64))
        total = np.zeros(n, np.uint64)
        for k in range(self.shingle):
            total += h[k:k + n] * self.factors[k]
        found = np.sort(mix64(total))  # faster than np.unique
        return found[np.append(True, found[1:] != found[:-1])]


def shingler(shingle: int) -> Shingler:
    return per_worker(("shingles", shingle), lambda: Shingler(shingle))


def bit_sketch(elements: np.ndarray) -> bytes:
    """Parities of the elements that fall on each of 2 to 4 bits an element, at least 64."""
    width = max(64, 1 << (2 * len(elements) - 1).bit_length())
    place = (mix64(elements ^ np.uint64(_GOLD)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=width) & 1).astype(np.uint8)).tobytes()


class BitSketches(Sketches):
    """Bit sketches of several widths, each folded once to every narrower width."""

    def __init__(self, sketches: list[bytes], sizes: np.ndarray, percent: int) -> None:
        super().__init__(sketches, sizes)
        self.percent = percent
        self.width = np.array([len(s) for s in sketches])
        self.rows: dict[int, np.ndarray] = {}
        self.place = np.zeros(len(sketches), np.int64)
        widths = sorted(set(self.width.tolist()), reverse=True)
        # the widest first: a narrower width takes the wider rows, folded, before its own
        order = np.argsort(-self.width, kind="stable")
        self.place[order] = np.arange(len(sketches))
        above = np.zeros((0, widths[0] if widths else 8), np.uint8)
        for w in widths:
            while above.shape[1] > w:
                half = above.shape[1] // 2
                above = above[:, :half] ^ above[:, half:]
            own = b"".join(sketches[i] for i in order[self.width[order] == w])
            above = np.concatenate([above, np.frombuffer(own, np.uint8).reshape(-1, w)])
            self.rows[w] = above

    def remote(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        width = np.minimum(self.width[i], self.width[j])
        apart = np.zeros(len(i), np.int64)
        for w, rows in self.rows.items():
            at = np.flatnonzero(width == w)
            step = max(1, (16 << 20) // w)
            words = rows.view(np.uint64)  # at least eight bytes wide
            for k in range(0, len(at), step):
                some = at[k:k + step]
                differ = words[self.place[i[some]]] ^ words[self.place[j[some]]]
                apart[some] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        allowed = (100 - self.percent) * (self.sizes[i].astype(np.int64) + self.sizes[j])
        return apart * (100 + self.percent) / np.maximum(allowed, 1)


def likeness(shingle: int, percent: int) -> Likeness:
    def elements(text: str) -> np.ndarray | None:
        words = word_list(text)
        return shingler(shingle)(words) if words else None

    return Likeness(partial(BitSketches, percent=percent), elements, percent)
