import random

import numpy as np
import pyarrow as pa
import pytest

from readtrail.llm import linking, parity, shingles
from tests.llm.conftest import ODD_ROWS
from tests.llm.test_neardup import brute, edited


def groups(docs, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in parity.join_groups(docs, **more).collect()}


def wanted(rows, percent=85):
    return {d: row[:2] for d, row in brute(rows, 4, percent).items()}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = []
    for base in range(14):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([9, 12, 25, 80, 200]))]
        out += [edited(words, r.randrange(0, 4), 100 * base + i) for i in range(8)]
        out += [" ".join(words).upper(), "  ".join(words), " ".join(words[:-1]), " ".join(["x", *words])]
    passage = [f"p{i}" for i in range(60)]  # shared by otherwise different texts
    out += [" ".join(passage + [f"q{r.randrange(10**6)}" for _ in range(r.randrange(5, 60))]) for _ in range(60)]
    chain = [f"c{i}" for i in range(300)]  # each link close to the next, the ends far apart
    out += [" ".join(chain[i:i + 150]) for i in range(0, 150, 4)]
    out += ["", "a b", "A B", "a b c", None, "x y z w", "x y z w v", "x y z w x y z w x y z w"]
    r.shuffle(out)
    return list(enumerate(out))


def test_against_brute_force(documents, rows):
    got = groups(documents(*rows))
    assert got == wanted(rows)
    assert sum(c != d for d, (_, c) in got.items()) > 60


def test_in_buckets_dealt_into_blocks(documents, monkeypatch):
    """Without waves, so that all links are found across components."""
    monkeypatch.setattr(linking, "LARGE", 4)
    monkeypatch.setattr(linking, "WAVES", ())
    passage = [f"p{i}" for i in range(60)]
    tails = [[f"q{k}-{i}" for i in range(12)] for k in range(10)]
    rows = list(enumerate(edited(passage + tail, n, n) for tail in tails for n in range(3)))
    assert groups(documents(*rows)) == wanted(rows)


def test_pairs_at_the_threshold_share_a_part():
    """No pair of sets may be missed by the look-up, whatever their sizes."""
    r = np.random.default_rng(2)
    bands = parity.Bands(85)
    missed = tried = 0
    for n in [*range(6, 60), 97, 150, 333, 1000, 4000]:
        for _ in range(20):
            total = r.integers(n, n + max(2, n // 5))  # of both sets together, as a union
            apart = total * 15 // 100
            union = np.unique(r.integers(0, 1 << 63, total, dtype=np.uint64))
            lost = r.permutation(len(union))[:apart]
            cut = r.integers(0, apart + 1)
            a, b = np.delete(union, lost[:cut]), np.delete(union, lost[cut:])
            shared = len(np.intersect1d(a, b))
            if 100 * shared < 85 * len(union):
                continue
            tried += 1
            missed += not set(parity.part_keys(a, bands).tolist()) & set(parity.part_keys(b, bands).tolist()) and len(a) + len(b) > 2 * shared
            sketches = shingles.BitSketches([shingles.bit_sketch(a), shingles.bit_sketch(b)], np.array([len(a), len(b)]), 85)
            assert sketches.remote(np.array([0]), np.array([1]))[0] <= 1
    assert tried > 500 and missed == 0


@pytest.mark.parametrize("small", [96, 4])
def test_merging_pairs_are_fewer_than_classes(monkeypatch, small):
    monkeypatch.setattr(linking, "SMALL", small)
    like = shingles.likeness(4, 85)
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 1 << 63, 200, dtype=np.uint64))
    sets = [np.sort(np.append(base, np.uint64(i))) for i in range(40)]
    table = pa.table({
        "meeting": pa.array([1] * 40), "side": pa.array([0] * 40, pa.int32()), "cid": pa.array(range(40)), "own": pa.array(range(40)),
        "n": pa.array([len(s) for s in sets]), "sketch": pa.array([shingles.bit_sketch(s) for s in sets], pa.binary()),
        "refused": pa.array([[1, 2]] + [None] * 39, pa.list_(pa.int64())),
    })
    pairs = linking.pairs_to_ask(table, like)
    assert len(pairs) == 39 and not {(0, 1), (0, 2)} & set(pairs)


def test_odd_rows(odd, documents):
    got = [tuple(r) for r in parity.join_groups(odd).collect()]
    assert len(got) == len(ODD_ROWS)
    by_size = sorted((n, c is None) for _, n, c in got)
    assert by_size == sorted([
        (0, False), (0, False), (0, False), (1, False), (1, False), (2, False), (2, False), (2, False),
        (1, True), (0, True), (1, False), (6, False),
    ])
    assert {c for d, n, c in got if n == 2 and d in (6, 7)} == {6}
    assert parity.join_groups(documents((1, "a")).where("false")).collect() == []


def test_clashing_columns(documents):
    from pyspark.sql import functions as F

    rows = [(1, "a b c d e"), (2, "A b c d e"), (3, "other words that stand alone")]
    docs = documents(*rows).withColumns({c: F.lit(0) for c in ("cid", "bucket", "key", "label", "n", "_row", "a", "b")})
    assert groups(docs) == {1: (2, 1), 2: (2, 1), 3: (2, 3)}
