"""Jaccard join of word n-gram sets by parity sketches.

A sketch is the exclusive-or of its elements' hashes, so what two sets share cancels out and
the sketches differ in no more places than the sets do (their Hamming distance is at most
the symmetric difference).  Two sketches are used:

* For the join, the places are parts of 64 bits: an element falls into one part and toggles
  it by its hash.  Sets of sizes up to u with a Jaccard likeness of t differ in at most
  d = 2 u (1 - t) / (1 + t) elements, so of d + 1 + e parts at least 1 + e are equal.  A set
  with at most e empty parts shares a part with elements in it, and only such parts are
  looked up; a set with more empty parts looks up those as well.  Sets are dealt into bands
  of sizes, since d grows with them; a set is in its own band and in those above in which it
  may have a partner.
* For candidates, a place is one bit, an element toggles one.  Pairs whose bits differ in
  more than d places are no links.  A wider sketch folds to the width of a narrower one.

Both bounds are exact: nothing is lost but by two different parts with one 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtrail.llm.common import map_rows, mix64, shuffle_partitions, staged, temporary_tables, whole_text
from readtrail.llm.linking import connect
from readtrail.llm.repeats import numbered
from readtrail.llm.shingles import SHINGLE, Shingler, bit_sketch, likeness, word_list

PERCENT = 85
BAND = 1.25  # how much larger the sizes of a band may be than those of the band below
RARE = 1e-6  # share of sets that may have more than e empty parts
FLUSH_KEYS = 1 << 20
PART_KEYS = 1 << 20  # look-up keys that meet in one task
_GOLD = 0x9E3779B97F4A7C15
_ZERO = np.zeros(1, np.int64)


def differences(total: int, percent: int) -> int:
    """Most elements that differ between linked sets of `total` elements together."""
    return (100 - percent) * total // (100 + percent)


def _surplus(least: int, d: int) -> int:
    """Empty parts e that a set of `least` elements very rarely exceeds in d + 1 + e parts."""
    for e in range(2 * d + 6):
        parts = d + 1 + e
        mean = parts * (1 - 1 / parts) ** least
        below = sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(e + 1)) if mean > 0 else 1.0
        if 1 - below < RARE:
            return e
    return 2 * d + 5


class Bands:
    """Size bands: upper bounds, and the parts and surplus of each."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        top = 1
        while differences(2 * (top + 1), percent) == 0:
            top += 1
        self.tops = [top]  # up to here only equal sets are linked

    @lru_cache(maxsize=1 << 16)  # noqa: B019 - one object per worker
    def of(self, n: int) -> tuple[tuple[int, int, int], ...]:
        """(band, parts, surplus) of every band in which a set of n elements looks for partners."""
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * BAND)))
        own = next(j for j, top in enumerate(self.tops) if n <= top)
        out = [self._band(own)] if own else []
        j = own + 1
        while True:
            if len(self.tops) == j:
                self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * BAND)))
            if 100 * n < self.percent * (self.tops[j - 1] + 1):
                return tuple(out)
            out.append(self._band(j))
            j += 1

    @lru_cache(maxsize=4096)  # noqa: B019
    def _band(self, j: int) -> tuple[int, int, int]:
        d = differences(2 * self.tops[j], self.percent)
        e = _surplus(-(-self.percent * (self.tops[j - 1] + 1) // 100), d)
        return j, d + 1 + e, e


def part_keys(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """Look-up keys: hashes of (band, part, exclusive-or of the elements in it).

    Elements are sorted hashes, so those of a part (their leading bits) lie together.
    """
    out = []
    toggles = mix64(elements * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    lead = elements >> np.uint64(32)
    for j, parts, surplus in bands.of(len(elements)):
        part = lead * np.uint64(parts) >> np.uint64(32)
        first = np.flatnonzero(part[1:] != part[:-1]) + 1
        first = np.concatenate([_ZERO, first])
        place = part[first]
        value = np.bitwise_xor.reduceat(toggles, first)
        if parts - len(place) > surplus:
            whole = np.zeros(parts, np.uint64)
            whole[place.astype(np.int64)] = value
            place, value = np.arange(parts, dtype=np.uint64), whole
        out.append(mix64(value ^ mix64((place + np.uint64(j << 40)) * np.uint64(_GOLD) + np.uint64(1))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _described(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Per row its set's hash (null without words) and size; sketch and keys with a set's first row in a task."""

    def described(batches) -> Iterator[tuple]:
        cut, bands = Shingler(shingle), Bands(percent)
        seen: set[bytes] = set()
        for batch in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = word_list(text)
                if not words:
                    yield row, doc, None, None, 0, None, None
                    continue
                found = cut(words)
                key = xxhash.xxh3_128_digest(found.tobytes())
                half = int.from_bytes(key[:8], "little", signed=True)
                if key in seen:
                    yield row, doc, key, half, len(found), None, None
                    continue
                if len(seen) >= 1 << 18:  # forgetting one only sends its set again
                    seen.clear()
                seen.add(key)
                yield row, doc, key, half, len(found), bit_sketch(found), part_keys(found, bands).tobytes()

    source = rows.select("_row", "doc_id", "text")
    return map_rows(source, described, "row long, doc_id long, key binary, half long, n long, sketch binary, keys binary")


def _first_of_runs(keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


def _several(half: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per run of one key, whether it holds more than one set."""
    at = np.flatnonzero(first)
    return np.minimum.reduceat(half, at) != np.maximum.reduceat(half, at)


def _packed(parts: int):
    """Rows (part, kind, n, data) of look-up keys: one entry a key, and all sets of keys that have several here."""

    def rows(batches) -> Iterator[tuple]:
        held: list[np.ndarray] = []
        halves: list[tuple[int, int]] = []

        def flush() -> Iterator[tuple]:
            keys = np.concatenate(held)
            half = np.repeat(np.array([h for h, _ in halves], np.int64), [n for _, n in halves])
            order = np.argsort(keys, kind="stable")
            keys, half = keys[order], half[order]
            first = _first_of_runs(keys)
            several = _several(half, first)
            met = several[np.cumsum(first) - 1]
            if met.any():
                spread = int(keys[0] % np.uint64(parts))  # anywhere: these need no others
                yield spread, 1, int(met.sum()), keys[met].tobytes() + half[met].tobytes()
            keys, half = keys[first], half[first]
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, half, several, part = keys[order], half[order], several[order], part[order]
            starts = np.flatnonzero(_first_of_runs(part))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
                data = keys[lo:hi].tobytes() + half[lo:hi].tobytes() + several[lo:hi].tobytes()
                yield int(part[lo]), 0, hi - lo, data

        n = 0
        for batch in batches:
            for half, keys in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(np.frombuffer(keys, np.uint64))
                halves.append((half, len(held[-1])))
                n += len(held[-1])
                if n >= FLUSH_KEYS:
                    yield from flush()
                    held, halves, n = [], [], 0
        if n:
            yield from flush()

    return rows


def _met(table: pa.Table) -> pa.Table:
    """(bucket, half) of the keys of one part that several sets have."""
    found = []
    entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for kind, n, data in zip(*(table[c].to_pylist() for c in ("kind", "n", "data"))):
        keys, half = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int64, n, 8 * n)
        if kind:
            found.append((keys, half))
        else:
            entries.append((keys, half, np.frombuffer(data, bool, n, 16 * n)))
    if entries:
        keys, half, flagged = (np.concatenate(x) for x in zip(*entries))
        order = np.argsort(keys, kind="stable")
        keys, half, flagged = keys[order], half[order], flagged[order]
        first = _first_of_runs(keys)
        several = _several(half, first) | np.logical_or.reduceat(flagged, np.flatnonzero(first))
        met = several[np.cumsum(first) - 1]
        found.append((keys[met], half[met]))
    keys, half = (np.concatenate(x) for x in zip(*found))
    return pa.table({"bucket": keys, "half": half})


def join_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`doc_id`, `n_shingles` and `component_id` of every row.

    Rows are linked whose word n-gram sets have 100 * intersection >= percent * union; the
    component's id is its smallest doc_id.  Null and empty texts and texts without words have
    size 0 and are linked with nothing.  Rows that repeat a text, or an id, are rows of their
    own; the id of a component is null only if all of its ids are.  Other columns are not
    looked at.
    """
    with temporary_tables(docs.sparkSession) as kept:
        rows = numbered(docs.select("doc_id", whole_text().alias("text")))
        described = staged(_described(rows, shingle, percent), "parity-rows")
        filled = described.where("key IS NOT NULL")
        # looked up by half of its hash: two sets with one half are candidates, no more
        classes = staged(filled.groupBy("key", "half").agg(F.min("row").alias("cid")), "parity-sets")
        sent = filled.where("octet_length(keys) > 0")
        total = (sent.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8
        parts = max(shuffle_partitions(docs.sparkSession), -(-total // PART_KEYS))
        packed = map_rows(sent.select("half", "keys"), _packed(parts), "part int, kind int, n int, data binary", flush=64)
        met = packed.groupBy("part").applyInArrow(_met, "bucket long, half long").distinct()
        items = staged(met.join(classes.select("half", "cid"), "half").select("bucket", "cid"), "parity-items")
        wanted = items.select("cid").distinct().join(classes.select("cid", "key"), "cid")
        sketches = staged(
            filled.where("sketch IS NOT NULL").select("key", "n", "sketch").join(wanted, "key")
            .dropDuplicates(["cid"]).select("cid", "n", "sketch"), "parity-sketches",
        )
        texts = rows.select(F.col("_row").alias("cid"), "text")
        labels = connect(items, sketches, texts, likeness(shingle, percent))
        named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(
            "key", F.coalesce("label", "cid").alias("label")
        )
        owned = filled.select("doc_id", "n", "key").join(named, "key")
        first = owned.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        linked = owned.join(first, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        alone = described.where("key IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return kept(linked.unionByName(alone), "parity-groups")
