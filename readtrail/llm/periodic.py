"""Periodic runs of words, from suffix trees and Lyndon roots.

A run is a stretch of words with smallest period q that is at least 2 q (and 12) words long
and that no neighbouring word extends.  Every run holds a Lyndon word of its period that is
the longest Lyndon word from its place, in one of the two orders of the words.  So the
longest Lyndon word at every place, in both orders, extended to the left and to the right as
far as its period goes on, gives all runs.  Both extensions are longest common extensions:
of the suffix tree of the words for the right, of the tree of their reversal for the left.

Trees are built over the stretches in which words repeat near by (`stretches`).  No run
reaches out of those: two periods lie next to each other in it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readtrail.llm.common import map_rows, mix64, whole_text
from readtrail.llm.suffix_tree import Extensions, SuffixTree

LEAST = 12  # words of a run
GRAM = 6  # words that surely come again within any run

Run = tuple[int, int, int]  # first word, words, period
Change = Callable[[int | None, list[bytes]], list[bytes]]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (low, high) outside of which no run has a word.

    A run of period q agrees with itself q words on, over at least max(q, 12 - q) words.  So
    for the length g of 6, 12, 24, … with q < 2 g (and g <= q, beyond the first), all its
    words lie in g-grams that come again, before or after, less than 2 g words away.
    """
    n = len(ids)
    if n < LEAST:
        return []
    covered = np.zeros(n + 1, np.int64)
    gram = mix64(ids + np.uint64(1))
    keys = gram[:n - GRAM + 1].copy()
    for k in range(1, GRAM):
        keys = mix64(keys * np.uint64(31) + gram[k:n - GRAM + 1 + k])
    size = GRAM
    while True:
        order = np.argsort(keys, kind="stable")
        again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        if not len(again):  # longer grams do not repeat either
            break
        first, second = order[again], order[again + 1]
        near = second - first < 2 * size
        for places in (first[near], second[near]):
            np.add.at(covered, places, 1)
            np.subtract.at(covered, places + size, 1)
        if 4 * size > n:
            break
        keys = mix64(keys[:-size] * np.uint64(31) + keys[size:])
        size *= 2
    edge = np.diff((np.cumsum(covered[:-1]) > 0).astype(np.int8), prepend=0, append=0)
    return [(lo, hi) for lo, hi in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()) if hi - lo >= LEAST]


def _lyndon_lengths(place: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place: up to the next smaller suffix."""
    rank = place.tolist()
    n = len(rank) - 1  # the empty suffix, smaller than all, comes last
    smaller = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j = i + 1
        own = rank[i]
        while rank[j] > own:
            j = smaller[j]
        smaller[i] = j
    return np.array(smaller[:n], np.int64) - np.arange(n)


def _runs_of_stretch(symbols: list[int]) -> np.ndarray:
    n = len(symbols)
    tree = SuffixTree(symbols)
    ahead = Extensions(*tree.tour())
    falling = np.empty(n + 1, np.int64)
    falling[tree.tour(falling=True)[0]] = np.arange(n + 1)
    back = Extensions(*SuffixTree(symbols[::-1]).tour())
    at = np.arange(n)
    found = []
    for place in (ahead.place, falling):
        period = _lyndon_lengths(place)
        right = ahead.common(at, at + period)
        left = back.common(n - at, n - at - period)
        length = left + period + right
        fits = length >= np.maximum(LEAST, 2 * period)
        found.append(np.stack([at - left, length, period], axis=1)[fits])
    return np.unique(np.concatenate(found), axis=0)


def runs_of(words: list[bytes]) -> list[Run]:
    """All runs, by first word, then period."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    out: list[Run] = []
    for low, high in stretches(ids):
        for start, length, period in _runs_of_stretch(ids[low:high].tolist()).tolist():
            out.append((low + start, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    inside = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        inside[start + period] += 1
        inside[start + length] -= 1
    stay = np.cumsum(inside[:-1]) == 0
    return [w for w, s in zip(words, stay.tolist()) if s]


def map_runs(
    docs: DataFrame, keep: tuple[str, ...], emit: Callable[[list[bytes], list[Run]], tuple], schema: str,
    change: Change | None = None,
) -> DataFrame:
    """The kept columns and what `emit(words, runs)` gives for each document.

    `change(doc_id, words)` may replace the words first.  Null and empty texts have no words.
    A document is handled whole, whatever its length; rows are independent of each other.
    """
    new = {f.name for f in StructType.fromDDL(schema)}
    keep = tuple(c for c in keep if c not in new)
    types = dict(docs.dtypes)

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            *others, ids, texts = batch.columns
            others = [o.to_pylist() for o in others]
            for i, (doc, text) in enumerate(zip(ids, texts)):
                # blanks between words are exactly those that bytes are split at
                words = text.as_py().encode().split()
                if change is not None:
                    words = change(doc.as_py(), words)
                yield (*(o[i] for o in others), *emit(words, runs_of(words)))

    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("doc_id").alias("_id"), whole_text().alias("_text"))
    return map_rows(source, rows, "".join(f"`{c}` {types[c]}, " for c in keep) + schema)


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `runs`, a list of (start, length, period), empty if there are none."""

    def emit(words: list[bytes], runs: list[Run]) -> tuple:
        return ([{"start": s, "length": n, "period": p} for s, n, p in runs],)

    return map_runs(docs, keep, emit, "runs array<struct<start: long, length: long, period: long>>")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """Documents whose runs are cut down to one period, their words joined by one blank."""
    kept = lambda words, runs: (b" ".join(kept_words(words, runs)).decode(),)
    changed = map_runs(docs, tuple(c for c in docs.columns if c != "text"), kept, "text string")
    return changed.select(*(f"`{c}`" for c in docs.columns))


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Damage for the check: one document in ten repeats itself from some word on.

    Documents without an id stay as they are.
    """
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + period] * (1 + (n - a) // period))[:n - a]


def run_digests(docs: DataFrame) -> DataFrame:
    def emit(words: list[bytes], runs: list[Run]) -> tuple:
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        longest = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        start, length, period = longest or (None, None, None)
        exponent = 1000 * length // period if longest else None
        rest = b" ".join(kept_words(words, runs))
        return (len(runs), start, length, period, exponent,
                hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())

    schema = ("n_runs long, start long, length long, period long, exponent_milli long, "
              "runs_sha256 string, collapsed_sha256 string")
    return map_runs(docs, ("doc_id",), emit, schema, made_periodic)
