"""Near-duplicate groups by SuperMinHash, banding, exact checks and union-find.

A text's set is its distinct word shingles.  SuperMinHash gives every element a random
permutation of the signature's places and one rank after the other; a place keeps the
smallest rank.  Ranks of one element are correlated, which lowers the variance, and once
every place has a rank of some level no later level can win, so the walk stops early.

Texts with the same set are one class.  Classes that agree in a band meet in a bucket, and
buckets are worked off as `linking.py` says: bands in waves, then all with all across
components, each link confirmed on full sets.  Bit sketches (`shingles.py`) leave out pairs
that cannot be linked before their sets are fetched; that bound is exact, so only a pair
that agrees in no band is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtrail.llm.common import map_rows, mix64, staged, temporary_tables, whole_text
from readtrail.llm.linking import connect
from readtrail.llm.repeats import numbered
from readtrail.llm.shingles import SHINGLE, bit_sketch, likeness, shingler, word_list

PLACES = 256
BANDS = 32
ROWS = 4  # places in a band
PERCENT = 80
LEVEL = np.uint64(56)  # bits of a rank below its level
_GOLD = 0x9E3779B97F4A7C15


def super_minhash(elements: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The signature: per place the smallest rank, level above random bits, of any element."""
    n = len(elements)
    best = np.full(places, np.uint64(0xFFFFFFFFFFFFFFFF))
    turn: np.ndarray | None = None
    every = np.arange(n)
    for level in range(places):
        u = mix64(elements + np.uint64((level + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF))
        k = level + ((u >> np.uint64(32)) * np.uint64(places - level) >> np.uint64(32)).astype(np.int64)
        if turn is None:
            place = k
            if n < places * 8:  # most texts need further levels
                turn = np.tile(np.arange(places, dtype=np.uint8), (n, 1))
                turn[every, k] = 0
        else:
            place = turn[every, k].astype(np.int64)
            turn[every, k] = turn[:, level]
        if level:  # a place that has a rank of a lower level keeps it
            still = np.flatnonzero(best[place] >> LEVEL >= level)
            place, u = place[still], u[still]
        np.minimum.at(best, place, mix64(u) >> np.uint64(64) - LEVEL | np.uint64(level) << LEVEL)
        if int(best.max() >> LEVEL) <= level:
            break
        if turn is None:  # a long text that still has an open place: its permutations after all
            turn = np.tile(np.arange(places, dtype=np.uint8), (n, 1))
            turn[every, k] = 0
    return best


def band_keys(signature: np.ndarray) -> list[int]:
    rows = signature[:BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * np.uint64(31) + rows[:, k])
    return key.view(np.int64).tolist()


def _described(rows: DataFrame, shingle: int) -> DataFrame:
    """Per row its set's hash (null without words) and size; bands and bit sketch with a set's first row in a task."""

    def described(batches) -> Iterator[tuple]:
        cut = shingler(shingle)
        seen: set[bytes] = set()
        for batch in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = word_list(text)
                if not words:
                    yield row, doc, None, 0, None, None
                    continue
                found = cut(words)
                key = xxhash.xxh3_128_digest(found.tobytes())
                if key in seen:
                    yield row, doc, key, len(found), None, None
                    continue
                if len(seen) >= 1 << 18:  # forgetting one only sends its set again
                    seen.clear()
                seen.add(key)
                yield row, doc, key, len(found), band_keys(super_minhash(found)), bit_sketch(found)

    source = rows.select("_row", "doc_id", "text")
    return map_rows(source, described, "row long, doc_id long, key binary, n long, bands array<long>, sketch binary")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` and `kept` of every row.

    Links join texts with 100 * intersection >= percent * union.  Null and empty texts and
    texts without words have size 0 and are linked with nothing.  Rows of one set are one
    class whatever their ids; the component's id is the smallest of its rows, null only if
    all are null.  A row is kept if its id is the component's, so rows that repeat an id
    share its fate.  Other columns are not looked at.
    """
    with temporary_tables(docs.sparkSession) as kept:
        rows = numbered(docs.select("doc_id", whole_text().alias("text")))
        described = staged(_described(rows, shingle), "near-rows")
        filled = described.where("key IS NOT NULL")
        names = staged(filled.groupBy("key").agg(F.min("row").alias("cid")), "near-keys")
        classes = staged(
            filled.where("sketch IS NOT NULL").select("key", "n", "bands", "sketch").join(names, "key")
            .dropDuplicates(["cid"]).select("cid", "n", "bands", "sketch"), "near-classes",
        )
        # the bands of a signature differ, so a class is in a bucket once
        items = classes.select("cid", F.explode("bands").alias("bucket"))
        texts = rows.select(F.col("_row").alias("cid"), "text")
        labels = connect(items, classes.drop("bands"), texts, likeness(shingle, percent))
        named = names.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(
            "key", F.coalesce("label", "cid").alias("label")
        )
        owned = filled.select("doc_id", "n", "key").join(named, "key")
        first = owned.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        linked = owned.join(first, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        alone = described.where("key IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        grouped = linked.unionByName(alone)
        return kept(grouped.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-groups")
