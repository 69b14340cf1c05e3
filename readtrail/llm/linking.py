"""From shared buckets to the links that connect every group of similar classes.

A class stands for all texts with one set.  Classes of a bucket may be linked; links are
confirmed on full sets.  Not every link is needed: a class pair within one component tells
nothing new, so buckets matter only while they hold several components.  Of buckets with the
same classes one is kept.

*Waves.*  An eighth of the buckets, then a quarter: in each open bucket every class meets
the bucket's centre, and of a class's centres only the first in one order over all classes.
So a wave asks for one pair a class at most, and a group of near copies is connected after
them, whatever its size.

*Across.*  What is still open, in all buckets, is compared all with all, but across
components only.  A task holds whole buckets, merges components in order of likeness of
their sketches, and gives out only the pairs that merged, less than one for each class.
Pairs may be hidden behind a pair that full sets refuse.  Further rounds look at the components
around refused pairs alone: there every class asks for its nearest class of another
component, twice, and what then still has one to ask for asks for all of them.  A bucket that is too large for a task is dealt into blocks; large components get blocks of their own,
and only pairs of blocks that hold different components meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrail.llm.common import map_rows, perhaps_among, shuffle_partitions, staged
from readtrail.llm.components import components

WAVES = ((0,), (1, 2))  # eighths of the buckets
LARGE = 4096  # classes in a bucket beyond which it is dealt into blocks of half as many
SMALL = 96  # classes in a bucket up to which all of its pairs are listed at once
GROUP_BYTES = 16 << 20  # sketches that are compared in one task
PAIRS = 1 << 20  # listed at once
MERGING, NEAREST, ALL = "merging", "nearest", "all"  # which agreeing pairs a round asks for
_ORDERS = (0x2545F4914F6CDD1D, 0x1B873593CC9E2D51)


class Sketches:
    """Sketches of the classes that a task compares."""

    def __init__(self, sketches: list[bytes], sizes: np.ndarray) -> None:
        self.sizes = sizes

    def remote(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far apart the classes of each pair are; more than 1 means that they are not linked."""
        raise NotImplementedError


@dataclass(frozen=True)
class Likeness:
    """What makes two classes similar.

    sketches                     kind of sketches
    elements(text)               the full set as sorted 64-bit hashes, or None
    percent                      least intersection, in percent of the union
    """

    sketches: Callable[[list[bytes], np.ndarray], Sketches]
    elements: Callable[[str], np.ndarray | None]
    percent: int


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _side(df: DataFrame, name: str, *columns: str) -> DataFrame:
    return df.select(F.col("cid").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))


def _agreeing(pairs: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose set sizes and sketches allow a link."""
    sides = pairs.join(_side(classes, "b", "n", "sketch"), "b").join(_side(classes, "a", "n", "sketch"), "a")
    sized = sides.where(_sizes_fit(F.col("a_n"), F.col("b_n"), like.percent))

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            a, b, n, m, s, t = (c.to_pylist() for c in batch.columns)
            if not a:
                continue
            at = np.arange(len(a))
            near = like.sketches(s + t, np.array(n + m)).remote(at, at + len(a)) <= 1
            for i in np.flatnonzero(near).tolist():
                yield a[i], b[i]

    return map_rows(sized.select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch"), rows, "a long, b long")


def _judged(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """Every pair (a, b) and whether its full sets reach the threshold (`linked`)."""
    needed = staged(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), "needed")
    # so that texts of other classes are not shuffled where the ids are too many to be sent to the texts
    fetched = perhaps_among(texts, needed, "cid").join(needed, "cid", "left_semi").select("cid", "text")

    def sets(batches) -> Iterator[tuple]:
        for batch in batches:
            for cid, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = like.elements(text)
                if found is not None:
                    yield cid, found.tobytes()

    members = staged(map_rows(fetched, sets, "cid long, members binary"), "sets")
    both = pairs.join(_side(members, "b", "members"), "b").join(_side(members, "a", "members"), "a")

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                yield a, b, 100 * shared >= like.percent * (len(x) + len(y) - shared)

    return map_rows(both.select("a", "b", "a_members", "b_members"), rows, "a long, b long, linked boolean")


def _marked(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Items with `own`, the component of their class, of buckets that hold several (`size` items)."""
    marked = items.join(labels.select(F.col("node").alias("cid"), F.col("label").alias("own")), "cid", "left")
    marked = marked.withColumn("own", F.coalesce("own", "cid"))
    several = (
        marked.groupBy("bucket").agg(F.min("own").alias("x"), F.max("own").alias("y"), F.count("*").alias("size"))
        .where(F.col("x") != F.col("y")).select("bucket", "size")
    )
    return marked.join(several, "bucket")


def _centre_pairs(marked: DataFrame, turn: int) -> DataFrame:
    """At most one pair (a, b) for each class: with the first centre of its open buckets."""
    scramble = F.lit(_ORDERS[turn % len(_ORDERS)])
    order = F.col("cid").bitwiseXOR(scramble)  # an order over all classes, undone by the same step
    centres = marked.groupBy("bucket").agg(F.min(order).alias("centre"))
    owners = marked.select(F.col("cid").bitwiseXOR(scramble).alias("centre"), F.col("own").alias("centre_own")).distinct()
    chosen = (
        marked.join(centres, "bucket").select("cid", "own", "centre").distinct().join(owners, "centre")
        .where(F.col("own") != F.col("centre_own")).groupBy("cid").agg(F.min("centre").alias("centre"))
    )
    other = F.col("centre").bitwiseXOR(scramble)
    return chosen.select(F.least("cid", other).alias("a"), F.greatest("cid", other).alias("b")).distinct()


def _dealt(marked: DataFrame) -> DataFrame:
    """Items as (meeting, side, cid, own): each meeting is a bucket, or two blocks of a large one."""
    small = marked.where(F.col("size") <= LARGE).select(
        F.xxhash64("bucket").alias("meeting"), F.lit(0).alias("side"), "cid", "own"
    )
    large = marked.where(F.col("size") > LARGE)
    if large.isEmpty():
        return small
    counts = large.groupBy("bucket", "own").agg(F.count("*").alias("n_own"))
    blocks_of = lambda n: F.ceil(n * 2 / LARGE).cast("int")
    alone = F.col("n_own") > LARGE // 4
    placed = large.join(counts, ["bucket", "own"]).select(
        "bucket", "cid", "own", F.when(alone, F.col("own")).alias("big"),
        F.when(alone, F.xxhash64("own", F.pmod(F.xxhash64("cid"), blocks_of(F.col("n_own")))))
        .otherwise(F.pmod(F.xxhash64("own"), blocks_of(F.col("size")))).cast("long").alias("block"),
    )
    blocks = staged(placed.groupBy("bucket", "block").agg(F.min("big").alias("big")), "blocks")
    x, y = (blocks.select("bucket", F.col("block").alias(k), F.col("big").alias(f"{k}_big")) for k in "xy")
    met = x.join(y, "bucket").where("x <= y AND (x_big IS NULL OR y_big IS NULL OR x_big != y_big)")
    met = met.select("bucket", "x", "y", F.xxhash64("bucket", "x", "y").alias("meeting"))
    sides = met.select("bucket", F.col("x").alias("block"), "meeting", F.lit(0).alias("side")).unionByName(
        met.where("x != y").select("bucket", F.col("y").alias("block"), "meeting", F.lit(1).alias("side"))
    )
    return small.unionByName(placed.join(sides, ["bucket", "block"]).select("meeting", "side", "cid", "own"))


def _root(merged: list[int], i: int) -> int:
    while merged[i] != i:
        merged[i] = merged[merged[i]]
        i = merged[i]
    return i


def _blocks_of_meetings(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of meetings with about PAIRS pairs each."""
    pairs = np.cumsum(sizes * (sizes - 1) // 2)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(pairs, (pairs[lo - 1] if lo else 0) + PAIRS, "right")))
        yield lo, hi
        lo = hi


class _Nearest:
    """Per class the nearest class of another component that it was paired with."""

    def __init__(self, n: int) -> None:
        self.far, self.other = np.full(n, np.inf), np.full(n, -1)

    def note(self, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> None:
        order = np.argsort(far, kind="stable")
        far = far[order]
        for x, y in ((a[order], b[order]), (b[order], a[order])):
            own, first = np.unique(x, return_index=True)
            first = first[far[first] < self.far[own]]
            self.far[x[first]], self.other[x[first]] = far[first], y[first]

    def note_row(self, a: int, b: np.ndarray, far: np.ndarray) -> None:
        """The same for pairs of one class with distinct others."""
        if len(b):
            first = int(np.argmin(far))
            if far[first] < self.far[a]:
                self.far[a], self.other[a] = far[first], b[first]
            closer = far < self.far[b]
            self.far[b[closer]], self.other[b[closer]] = far[closer], a

    def pairs(self) -> set[tuple[int, int]]:
        at = np.flatnonzero(self.other >= 0)
        return {(min(p), max(p)) for p in zip(at.tolist(), self.other[at].tolist())}


def pairs_to_ask(table: pa.Table, like: Likeness, mode: str = MERGING) -> list[tuple[int, int]]:
    """Pairs of the buckets or block pairs of one task whose sketches agree, across components.

    MERGING gives those that merge components, nearest first, NEAREST every class's nearest.
    Columns: meeting, side, cid, own, n, sketch, refused (classes that full sets refused).
    """
    table = table.sort_by([("meeting", "ascending"), ("cid", "ascending")])
    meeting, side, cid, size = (table[c].to_numpy() for c in ("meeting", "side", "cid", "n"))
    owners, own = np.unique(table["own"].to_numpy(), return_inverse=True)
    # a class is there once for each of its buckets; its sketch is needed once
    classes, place, row = np.unique(cid, return_index=True, return_inverse=True)
    sketches = like.sketches(table["sketch"].take(pa.array(place)).to_pylist(), size[place])
    lists = table["refused"].take(pa.array(place)).combine_chunks()
    by = np.repeat(np.arange(len(classes)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    against = lists.flatten().to_numpy()
    there = np.minimum(np.searchsorted(classes, against), len(classes) - 1)
    refused_codes = (by * len(classes) + there)[classes[there] == against]
    merged = list(range(len(owners)))
    found: set[tuple[int, int]] = set()
    nearest = _Nearest(len(classes))
    codes: list[np.ndarray] = []

    def merge(i: int, j: int) -> None:
        a, b = _root(merged, int(own[i])), _root(merged, int(own[j]))
        if a != b:
            found.add((int(row[i]), int(row[j])))
            merged[max(a, b)] = min(a, b)

    def merge_all(i: np.ndarray, j: np.ndarray, far: np.ndarray) -> None:
        """Merge by growing chunks, nearest first; what earlier ones joined is left out of later ones."""
        order = np.argsort(far, kind="stable")
        lo, step = 0, 4096
        while lo < len(order):
            at = order[lo:lo + step]
            label = np.array(merged)
            while (label[label] != label).any():
                label = label[label]
            for k in at[label[own[i[at]]] != label[own[j[at]]]].tolist():
                merge(i[k], j[k])
            lo, step = lo + step, 2 * step

    def agreeing(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of items those that may be asked for, and how far they are apart."""
        fit = (own[i] != own[j]) & ((side[i] != side[j]) | ~two_sided[i])
        fit &= 100 * np.minimum(size[i], size[j]) >= like.percent * np.maximum(size[i], size[j])
        i, j = i[fit], j[fit]
        far = sketches.remote(row[i], row[j])
        near = np.flatnonzero(far <= 1)
        if len(near) and len(refused_codes):
            near = near[~np.isin(row[i[near]] * len(classes) + row[j[near]], refused_codes)]
        return i[near], j[near], far[near]

    starts = np.flatnonzero(np.diff(meeting, prepend=meeting[:1] - 1))
    sizes = np.diff(np.append(starts, len(meeting)))
    sided = np.maximum.reduceat(side, starts) > 0 if len(starts) else np.zeros(0, bool)
    two_sided = np.repeat(sided, sizes)  # two blocks: compared with each other only
    for lo, hi in _blocks_of_meetings(np.where(sizes <= SMALL, sizes, 0)):
        own_starts, own_sizes = starts[lo:hi][sizes[lo:hi] <= SMALL], sizes[lo:hi][sizes[lo:hi] <= SMALL]
        firsts, seconds = [], []
        for step in range(1, int(own_sizes.max(initial=1))):
            wide = own_sizes > step
            left = own_sizes[wide] - step
            i = np.repeat(own_starts[wide] - np.append(0, np.cumsum(left)[:-1]), left) + np.arange(left.sum())
            firsts.append(i)
            seconds.append(i + step)
        if not firsts:
            continue
        i, j = np.concatenate(firsts), np.concatenate(seconds)
        _, once = np.unique(row[i] * len(classes) + row[j], return_index=True)  # of several buckets
        i, j, far = agreeing(i[once], j[once])
        if mode == MERGING:
            merge_all(i, j, far)
        elif mode == NEAREST:
            nearest.note(row[i], row[j], far)
        else:
            codes.append(row[i] * len(classes) + row[j])
    for lo, m in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        later: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        for k in range(m - 1):
            if k == 0 or waiting > PAIRS:
                if later:
                    merge_all(*(np.concatenate(x) for x in zip(*later)))
                later, waiting = [], 0
                here = np.array([_root(merged, o) for o in own[lo:lo + m].tolist()])
            apart = np.flatnonzero(here[k + 1:] != here[k]) + k + 1
            i, j, far = agreeing(np.full(len(apart), lo + k), lo + apart)
            if mode != MERGING:
                nearest.note_row(int(row[lo + k]), row[j], far)
                if mode == ALL:
                    codes.append(row[i] * len(classes) + row[j])
                continue
            close = far <= 0.5
            for x in j[close].tolist():
                merge(lo + k, x)
                low, high = sorted((here[k], here[x - lo]))
                here[here == high] = low
            later.append((i[~close], j[~close], far[~close]))
            waiting += len(later[-1][0])
        if later:
            merge_all(*(np.concatenate(x) for x in zip(*later)))
    if mode == NEAREST:
        found = nearest.pairs()
    elif mode == ALL:
        found = {divmod(c, len(classes)) for c in np.unique(np.concatenate([np.zeros(0, np.int64), *codes])).tolist()}
    return [(int(classes[x]), int(classes[y])) for x, y in sorted(found)]


def _across(marked: DataFrame, classes: DataFrame, refused: DataFrame, like: Likeness, mode: str) -> DataFrame:
    """Fresh pairs (a, b) across components, of all open buckets."""
    dealt = staged(_dealt(marked).join(classes, "cid"), "met")
    spread = dealt.agg(F.sum(F.octet_length("sketch") + 64)).first()[0] or 0
    groups = max(shuffle_partitions(dealt.sparkSession), -(-spread // GROUP_BYTES))
    no = (
        refused.select("a", "b").union(refused.select("b", "a")).groupBy(F.col("a").alias("cid"))
        .agg(F.collect_list("b").alias("refused"))
    )
    items = dealt.join(no, "cid", "left").withColumn("part", F.pmod("meeting", F.lit(groups)))

    def compare(table: pa.Table) -> pa.Table:
        pairs = pairs_to_ask(table, like, mode)
        return pa.table({k: pa.array([p[i] for p in pairs], pa.int64()) for i, k in enumerate("ab")})

    compared = items.groupBy("part").applyInArrow(compare, "a long, b long")
    return compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _once(items: DataFrame) -> DataFrame:
    """Items of buckets with several classes; of buckets with the same classes, the first."""
    contents = items.groupBy("bucket").agg(
        F.count("*").alias("m"), *[F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(f"x{k}") for k in range(2)]
    )
    kept = contents.where("m > 1").groupBy("m", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket")
    return items.join(kept, "bucket", "left_semi")


def connect(items: DataFrame, classes: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """`node`, `label`: the smallest class of the component of every class that is linked.

    items    bucket, cid; each once
    classes  cid, n (set size), sketch; every class of `items`
    texts    cid, text; one text of every class, others may be there too
    """
    items = staged(_once(items), "items")
    # the texts that may be asked for, and a few others, once for all rounds and without a shuffle
    candidates = staged(items.select("cid").distinct(), "candidates")
    texts = staged(perhaps_among(texts.select("cid", "text"), candidates, "cid"), "texts")
    tables = shuffle_partitions(items.sparkSession)
    links = items.select(F.col("cid").alias("a"), F.col("cid").alias("b")).where("false")
    refused = links
    labels = components(links)

    def ask(pairs: DataFrame, sketched: bool) -> tuple[DataFrame, DataFrame] | None:
        """Confirm pairs; those asked for and those refused now, None if there was no pair to ask for."""
        nonlocal links, refused, labels
        fresh = staged(pairs.join(refused, ["a", "b"], "left_anti"), "pairs")
        if fresh.isEmpty():
            return None
        agreeing = fresh if sketched else staged(_agreeing(fresh, classes, like), "pairs")
        judged = staged(_judged(agreeing, texts, like), "judged")
        linked = judged.where("linked").select("a", "b")
        if not linked.isEmpty():
            links = staged(links.unionByName(linked).coalesce(tables), "links")
            labels = components(links)
        # a pair whose sketches exclude a link counts as refused too
        now = staged(fresh.join(linked, ["a", "b"], "left_anti").coalesce(tables), "refused")
        refused = staged(refused.unionByName(now).coalesce(tables), "refused")
        return fresh, now

    eighth = F.pmod(F.xxhash64("bucket"), F.lit(8))
    for turn, share in enumerate(WAVES):
        marked = staged(_marked(items.where(eighth.isin(*share)), labels), "open")
        if not marked.isEmpty():
            ask(_centre_pairs(marked, turn), False)
    open_items = staged(_marked(items, labels), "open")
    asked = None if open_items.isEmpty() else ask(_across(open_items, classes, refused, like, MERGING), True)
    if asked is None or asked[1].isEmpty():
        return labels
    # only pairs within what would have merged with the refused pairs were passed over
    now = asked[1]
    wide = components(links.unionByName(now))
    doubtful = wide.join(now.select(F.col("a").alias("node")), "node", "left_semi").select("label").distinct()
    left = wide.join(doubtful, "label", "left_semi").select(F.col("node").alias("cid"))
    for mode in chain((NEAREST, NEAREST), repeat(ALL)):
        open_items = staged(_marked(open_items.select("bucket", "cid").join(left, "cid", "left_semi"), labels), "open")
        asked = None if open_items.isEmpty() else ask(_across(open_items, classes, refused, like, mode), True)
        if asked is None:
            break
        # a class that had no pair to ask for will not have one later either
        left = asked[0].select(F.col("a").alias("cid")).union(asked[0].select("b")).distinct()
    return labels
