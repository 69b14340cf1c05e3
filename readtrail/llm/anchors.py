"""Anchors: positions that equal byte windows pick equally, and hashes of what is around them.

Every window of `window` bytes holds `window - gram + 1` grams; its anchor is the gram with
the smallest hash, leftmost on ties.  Equal windows have equal anchors at equal offsets, so
to compare windows it is enough to compare what lies around equal grams at anchors, about
two in every `window - gram` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from readtrail.llm.common import mix64

WINDOW = 100
GRAM = 32
REACH = WINDOW - GRAM  # bytes that a window can stretch before its anchor, or past its gram
SEGMENT = 1 << 19
OVERLAP = 2 * WINDOW
_PLACE = np.uint64((1 << 24) - 1)  # low bits of a sort value hold the place in a chunk
_BASE = 0x9E3779B97F4A7C15
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


_POWER = _powers(_BASE, 2 * SEGMENT + 2)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), 2 * SEGMENT + 2)


@dataclass
class Found:
    """Anchors of a chunk: hash of the gram, hash of the context, row, place, context bounds."""

    gram: np.ndarray
    context: np.ndarray
    row: np.ndarray
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray
    at: np.ndarray  # of the gram in the chunk's bytes
    data: np.ndarray

    def bytes_around(self, i: int) -> bytes:
        shift = int(self.at[i]) - int(self.place[i])
        return self.data[int(self.low[i]) + shift:int(self.high[i]) + shift].tobytes()


def segments(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Chunks of about SEGMENT bytes; longer rows are cut into overlapping segments."""
    numbers, offsets, parts, size = [], [], [], 0
    for number, data in rows:
        step = SEGMENT - OVERLAP
        for lo in range(0, max(1, len(data) - OVERLAP), step):
            part = data[lo:lo + SEGMENT]
            if len(part) < WINDOW:
                continue
            if size + len(part) > SEGMENT and parts:
                yield numbers, offsets, parts
                numbers, offsets, parts, size = [], [], [], 0
            numbers.append(number)
            offsets.append(lo)
            parts.append(part)
            size += len(part)
    if parts:
        yield numbers, offsets, parts


def anchors(numbers: list[int], offsets: list[int], parts: list[bytes]) -> Found:
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = len(data)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _POWER[:n], out=prefix[1:])
    grams = n - GRAM + 1
    gram = mix64((prefix[GRAM:] - prefix[:grams]) * _INVERSE[:grams])
    least = gram & ~_PLACE | np.arange(grams, dtype=np.uint64)
    width = 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    left = REACH + 1 - width
    if left:
        least = np.minimum(least[:-left], least[left:])
    # windows that lie within one segment
    segment = np.repeat(np.arange(len(parts)), np.maximum(sizes - WINDOW + 1, 0))
    first = np.cumsum(np.maximum(sizes - WINDOW + 1, 0)) - np.maximum(sizes - WINDOW + 1, 0)
    window = np.arange(len(segment)) - first[segment] + starts[segment]
    at = (least[window] & _PLACE).astype(np.int64)
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    at, segment = at[keep], segment[keep]
    low = np.maximum(at - REACH, starts[segment])
    high = np.minimum(at + WINDOW, ends[segment])
    around = (prefix[high] - prefix[low]) * _INVERSE[low]
    sides = (at - low).astype(np.uint64) << np.uint64(8) | (high - at).astype(np.uint64)
    shift = np.array(offsets, np.int64)[segment] - starts[segment]
    return Found(
        gram[at], mix64(around ^ mix64(sides)), np.array(numbers, np.int64)[segment],
        *((x + shift).astype(np.int32) for x in (at, low, high)), at.astype(np.int32), data,
    )
