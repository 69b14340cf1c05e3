"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the leading bits name its bin, and a bin keeps its smallest
hash.  An empty bin borrows from a bin that a hash of (bin, attempt) picks, attempts going
on until one is filled: optimal densification, the same picks for every document.  Only
the low bits of each bin are stored; the share of bins that agree by chance is taken out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readtrail.llm.common import (
    WORD, map_rows, mix64, per_worker, shuffle_partitions, staged, whole_text,
)

BIN_BITS = 9
BINS = 1 << BIN_BITS
STORED_BITS = 4
SHINGLE = 5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_words = re.compile(WORD)


def _picks(attempts: np.ndarray) -> np.ndarray:
    """Bins that each bin borrows from, one column per attempt."""
    key = np.arange(BINS, dtype=np.uint64)[:, None] << np.uint64(32) | attempts[None, :].astype(np.uint64)
    return (mix64(key + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BIN_BITS)).astype(np.int16)


class Fingerprinter:
    def __init__(self, shingle: int = SHINGLE) -> None:
        self.shingle = shingle
        odd = mix64(np.arange(1, shingle + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.factors = odd | np.uint64(1)
        self.blocks: list[np.ndarray] = []

    def picks(self, block: int) -> np.ndarray:
        """Attempts in blocks of 16, 256, 4096: few documents need more than the first."""
        while len(self.blocks) <= block:
            k = min(len(self.blocks), 2)
            done = sum(b.shape[1] for b in self.blocks)
            self.blocks.append(_picks(np.arange(done, done + 16 ** (k + 1))))
        return self.blocks[block]

    def shingles(self, text: str) -> np.ndarray:
        """Hashes of the word shingles; a shorter text is one shingle, an empty one none."""
        words = _words.findall(text)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = len(words) - self.shingle + 1
        if n < 1:
            n, h = min(1, len(words)), np.append(h, np.zeros(self.shingle - len(words), np.uint64))
        total = np.zeros(n, np.uint64)
        for k in range(self.shingle):
            total += h[k:k + n] * self.factors[k]
        return mix64(total)

    def bins(self, text: str) -> np.ndarray | None:
        hashes = self.shingles(text)
        if not len(hashes):
            return None
        least = np.full(BINS, _EMPTY)
        np.minimum.at(least, (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int16), hashes)
        filled = least != _EMPTY
        empty = np.flatnonzero(~filled)
        block = 0
        while len(empty):
            picks = self.picks(block)[empty]
            hit = filled[picks]
            first = hit.argmax(axis=1)
            found = hit[np.arange(len(empty)), first]
            least[empty[found]] = least[picks[found, first[found]]]
            empty = empty[~found]
            block += 1
        return (least & np.uint64((1 << STORED_BITS) - 1)).astype(np.uint8)


def packed(bins: np.ndarray | None) -> str:
    """Two bins a byte, in hex; an empty text has the empty fingerprint."""
    return "" if bins is None else _bytes(bins).hex()


def _bytes(bins: np.ndarray | None) -> bytes:
    return b"" if bins is None else (bins[0::2] << 4 | bins[1::2]).tobytes()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard likeness; two empty texts are alike, an empty and a filled one are not."""
    if a is None or b is None:
        return float(a is b)
    chance = 2.0**-STORED_BITS
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def unpacked(fingerprint: str) -> np.ndarray | None:
    if not fingerprint:
        return None
    data = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.stack([data >> 4, data & 15], axis=1).ravel()


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _maker() -> Fingerprinter:
    return per_worker("fingerprints", Fingerprinter)


def _compared(doc: int | None, text: str, own: np.ndarray | None, following: str, after: np.ndarray | None) -> tuple:
    changed = edited(text, following)
    bins = _maker().bins(changed)
    return (
        doc, len(text), hashlib.sha256(changed.encode()).digest(), _bytes(own), _bytes(bins),
        likeness(own, bins), likeness(own, after),
    )


RESULT = (
    "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)
IN_HEX = ("edited_sha256", "fingerprint", "edited_fingerprint")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """`doc_id`, `n_chars` and `fingerprint` of every text; nothing is shuffled."""

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                yield doc, len(text), packed(_maker().bins(text))

    source = docs.select("doc_id", whole_text().alias("text"))
    return map_rows(source, rows, "doc_id long, n_chars long, fingerprint string")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document, and their likeness.

    Next is by descending doc_id, null ids last, documents that share an id by a hash of
    their texts; after the last comes the first (a single document follows itself).  Texts
    are shuffled once, by range; a part's last document finds its next one in the first
    document of the next part, and only these edges are joined.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    source = docs.select("doc_id", whole_text().alias("text"))
    ordered = source.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)

    def rows(batches) -> Iterator[tuple]:
        part, maker = TaskContext.get().partitionId(), _maker()
        before = None
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                bins = maker.bins(text)
                if before is None:
                    yield part, "first", text, doc, *[None] * 6
                else:
                    yield part, "inner", None, *_compared(*before, text, bins)
                before = doc, text, bins
        if before is not None:
            yield part, "last", before[1], before[0], *[None] * 6

    parts = staged(map_rows(ordered, rows, f"_part int, _kind string, _text string, {RESULT}"), "fingerprints")
    first, last = parts.where("_kind = 'first'"), parts.where("_kind = 'last'")
    by_part = Window.orderBy("_part")
    turn = first.select("_part").select(
        "_part", F.coalesce(F.lead("_part").over(by_part), F.min("_part").over(Window.partitionBy())).alias("_next")
    )
    edges = (
        last.select("_part", "doc_id", "_text").join(turn, "_part")
        .join(first.select(F.col("_part").alias("_next"), F.col("_text").alias("_following")), "_next")
        .select("doc_id", "_text", "_following")
    )

    def edge_rows(batches) -> Iterator[tuple]:
        for batch in batches:
            for doc, text, following in zip(*(c.to_pylist() for c in batch.columns)):
                yield _compared(doc, text, _maker().bins(text), following, _maker().bins(following))

    inner = parts.where("_kind = 'inner'").drop("_part", "_kind", "_text")
    out = inner.unionByName(map_rows(edges, edge_rows, RESULT))
    return out.withColumns({c: F.lower(F.hex(c)) for c in IN_HEX})
