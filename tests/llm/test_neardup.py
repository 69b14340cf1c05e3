import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from readtrail.llm import components as C
from readtrail.llm import linking, neardup, shingles
from readtrail.llm.components import components


def sets_of(rows, k):
    out = {}
    for doc, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[doc] = {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return out


def brute(rows, k=4, percent=80):
    sets = sets_of(rows, k)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def edited(words, n, seed):
    r = random.Random(seed)
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for base in range(12):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 160))]
        out += [edited(words, r.randrange(0, 5), 100 * base + i) for i in range(8)]
        out += [" ".join(words).upper(), "  ".join(words)]
    passage = [f"p{i}" for i in range(60)]  # shared by otherwise different texts
    out += [" ".join(passage + [f"q{r.randrange(10**6)}" for _ in range(r.randrange(5, 60))]) for _ in range(90)]
    chain = [f"c{i}" for i in range(200)]  # each link close to the next, the ends far apart
    out += [" ".join(chain[i:i + 100]) for i in range(0, 100, 5)]
    out += ["", "a b", "A B", "a b c", None, "x y z w", "x y z w v"]
    r.shuffle(out)
    return list(enumerate(out))


def test_against_brute_force(documents, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_groups(documents(*rows)).collect()}
    want = brute(rows)
    assert want[next(i for i, t in rows if not t)][0] == 0
    assert got == want


def test_large_buckets_are_dealt_into_blocks_and_lose_nothing(documents, monkeypatch):
    monkeypatch.setattr(linking, "LARGE", 3)
    monkeypatch.setattr(linking, "WAVES", ())
    passage = [f"p{i}" for i in range(60)]
    tails = [[f"q{k}-{i}" for i in range(20)] for k in range(12)]
    rows = list(enumerate(edited(passage + tail, n, n) for tail in tails for n in range(3)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_groups(documents(*rows)).collect()}
    assert got == brute(rows)


def met_pairs(spark, size, owner):
    """All pairs of classes that meet when one bucket of this size is dealt."""
    marked = spark.createDataFrame([(1, i, owner(i), size) for i in range(size)], "bucket long, cid long, own long, size long")
    meetings = defaultdict(lambda: ([], []))
    for m in linking._dealt(marked).collect():
        meetings[m.meeting][m.side].append(m.cid)
    out = []
    for left, right in meetings.values():
        pairs = [(a, b) for i, a in enumerate(left) for b in left[i + 1:]] if not right else [(a, b) for a in left for b in right]
        out += [tuple(sorted(p)) for p in pairs if owner(p[0]) != owner(p[1])]
    return out


@pytest.mark.parametrize("owner", [lambda i: i, lambda i: i % 3, lambda i: min(i, 50), lambda i: 0 if i else 1])
def test_blocks_of_a_large_bucket_meet_in_every_pair_across_components(spark, monkeypatch, owner):
    monkeypatch.setattr(linking, "LARGE", 8)
    met = met_pairs(spark, 65, owner)
    want = {(i, j) for i in range(65) for j in range(i + 1, 65) if owner(i) != owner(j)}
    assert len(met) == len(set(met)) and set(met) == want


@pytest.mark.parametrize("small", [96, 8])
def test_merging_connects_what_agrees(monkeypatch, small):
    """The pairs given out join exactly the classes that chains of agreeing pairs join."""
    monkeypatch.setattr(linking, "SMALL", small)
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.append(r.permutation(base)[:94], r.integers(0, 1 << 63, 3, dtype=np.uint64))) for _ in range(65)]
    sketches, n = [shingles.bit_sketch(s) for s in sets], np.array([len(s) for s in sets])
    table = pa.table({
        "meeting": pa.array([i % 2 for i in range(65)]), "side": pa.array([0] * 65, pa.int32()), "cid": pa.array(range(65)),
        "own": pa.array(range(65)), "n": pa.array(n), "sketch": pa.array(sketches, pa.binary()),
        "refused": pa.array([None] * 65, pa.list_(pa.int64())),
    })
    like = shingles.likeness(4, 85)
    far = lambda i, j: like.sketches(sketches, n).remote(np.array([i]), np.array([j]))[0]
    want = [(i, j) for i in range(65) for j in range(i + 2, 65, 2) if far(i, j) <= 1]
    got = linking.pairs_to_ask(table, like)
    nearest, every = linking.pairs_to_ask(table, like, linking.NEAREST), linking.pairs_to_ask(table, like, linking.ALL)
    assert set(got) <= set(want) and sorted(every) == want and set(nearest) <= set(want) and 100 < len(want) < 900
    assert {i for p in nearest for i in p} == {i for p in want for i in p}

    def joined(pairs):
        groups = {i: {i} for i in range(65)}
        for i, j in pairs:
            if groups[i] is not groups[j]:
                groups[i] |= groups[j]
                for k in groups[j]:
                    groups[k] = groups[i]
        return {frozenset(g) for g in groups.values()}

    assert joined(got) == joined(want) and len(got) == 65 - len(joined(want))


def test_signature_is_the_sequential_definition():
    elements = neardup.mix64(np.arange(1, 40, dtype=np.uint64))

    def sequential(elements, m):
        best = [None] * m
        for x in elements:
            turn = list(range(m))
            for j in range(m):
                u = neardup.mix64(np.array([x + np.uint64((j + 1) * neardup._GOLD % 2**64)]))
                k = j + ((int(u[0]) >> 32) * (m - j) >> 32)
                turn[j], turn[k] = turn[k], turn[j]
                rank = j << 56 | int(neardup.mix64(u)[0]) >> 8
                if best[turn[j]] is None or rank < best[turn[j]]:
                    best[turn[j]] = rank
        return best

    for n in (1, 3, 39):
        assert neardup.super_minhash(elements[:n], 128).tolist() == sequential(elements[:n], 128)


def test_signatures_estimate_likeness():
    a = neardup.mix64(np.arange(0, 1000, dtype=np.uint64))
    b = neardup.mix64(np.arange(250, 1250, dtype=np.uint64))
    agree = (neardup.super_minhash(a) == neardup.super_minhash(b)).mean()
    assert abs(agree - 0.6) < 0.15
    long = neardup.mix64(np.arange(0, 40_000, dtype=np.uint64))
    assert (neardup.super_minhash(long) == neardup.super_minhash(long[::-1])).all()


def test_odd_rows(odd):
    got = defaultdict(set)
    for r in neardup.near_groups(odd.selectExpr("*", "1 AS key", "2 AS label")).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert got[1] == {(0, 1, True)} and got[2] == {(0, 2, True)} and got[3] == {(0, 3, True)}
    assert got[7] == {(2, 6, False)} and (2, 6, True) in got[6] and got[None] == {(1, None, True), (0, None, True)}
    assert neardup.near_groups(odd.where("false")).collect() == []


@pytest.mark.parametrize("links", [500_000, 4])
def test_components_of_a_long_path(spark, monkeypatch, links):
    monkeypatch.setattr(C, "TASK_LINKS", links)
    path = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(20)] + [("x", "y")], "a string, b string")
    got = {r.node: r.label for r in components(path).collect()}
    assert got.pop("y") == got.pop("x") == "x" and set(got.values()) == {"000"} and len(got) == 21


def test_recall_at_the_threshold(documents):
    """Pairs of likeness 0.80 to 0.82."""
    rows = []
    for k in range(90):
        words = [f"v{k}x{i}" for i in range(203)]  # 200 shingles
        kept = 181 + k % 3
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:kept], *[f"n{k}x{i}" for i in range(203 - kept)]]))]
    sets = sets_of(rows, 4)
    likeness = [len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(90)]
    assert min(likeness) >= 0.80 and max(likeness) < 0.82
    got = {x.doc_id: x.component_id for x in neardup.near_groups(documents(*rows)).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(90))


def test_texts_are_read_once_for_all_rounds(spark):
    like, read = shingles.likeness(4, 80), spark.sparkContext.accumulator(0)
    texts = [" ".join(f"c{k}" for k in range(4 * i, 4 * i + 100)) for i in range(24)]  # each linked with the next ones only
    sets = [like.elements(t) for t in texts]
    classes = spark.createDataFrame([(i, len(s), shingles.bit_sketch(s)) for i, s in enumerate(sets)], "cid long, n long, sketch binary")
    buckets = [(100 * i + j, c) for i in range(24) for j in range(i + 1, min(i + 4, 24)) for c in (i, j)]
    items = spark.createDataFrame(buckets, "bucket long, cid long")

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame(list(enumerate(texts)), "cid long, text string").mapInArrow(counted, "cid long, text string")
    labels = linking.connect(items, classes, rows, like)
    assert sorted(map(tuple, labels.collect())) == [(i, 0) for i in range(24)]
    assert read.value == 24
