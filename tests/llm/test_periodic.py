import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from readtrail.llm import periodic
from readtrail.llm.suffix_tree import Extensions, SuffixTree
from tests.llm.conftest import ODD_ROWS


def brute_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    g = h // 10
    if doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest())


def sequences(seed, n=60):
    r = random.Random(seed)
    for _ in range(n):
        alphabet = r.choice(["ab", "abc", "abcdefghij"])
        parts = []
        for _ in range(r.randint(1, 5)):
            unit = [r.choice(alphabet) for _ in range(r.randint(1, 20))]
            parts += (unit * r.randint(1, 6))[:r.randint(1, 60)]
        yield parts


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(seed):
    for words in sequences(seed):
        assert periodic.runs_of([w.encode() for w in words]) == brute_runs(words)


def test_nested_runs_and_runs_next_to_each_other():
    inner = ["a", "b"] * 6
    words = (inner + ["c"]) * 3 + ["d"] * 12 + ["e"] * 11 + ["f", "g", "h"] * 4
    got = periodic.runs_of([w.encode() for w in words])
    assert got == brute_runs(words)
    assert (0, 39, 13) in got and (0, 12, 2) in got and (39, 12, 1) in got
    assert not any(r[2] == 1 and r[1] == 11 for r in got)


def test_far_copies_build_no_tree():
    words = [b"w%d" % i for i in range(50)]
    far = words + [b"x%d" % i for i in range(500)] + words
    known = {}
    ids = np.array([known.setdefault(w, len(known)) for w in far], np.uint64)
    assert periodic.stretches(ids) == []


def test_common_extensions():
    r = random.Random(5)
    for _ in range(20):
        s = [r.randrange(3) for _ in range(r.randint(1, 60))]
        tree = SuffixTree(s)
        order, lowest = tree.tour()
        assert order.tolist() == sorted(range(len(s) + 1), key=lambda i: s[i:])
        falling = tree.tour(falling=True)[0].tolist()
        assert falling == sorted(range(len(s) + 1), key=lambda i: [-x for x in s[i:]])
        a, b = (x.ravel() for x in np.meshgrid(np.arange(len(s) + 1), np.arange(len(s) + 1)))
        a, b = a[a != b], b[a != b]
        want = [next((k for k in range(len(s)) if s[i + k:i + k + 1] != s[j + k:j + k + 1]), 0) for i, j in zip(a, b)]
        assert Extensions(order, lowest).common(a, b).tolist() == want


def test_documents_against_brute_force(documents):
    rows = [(i, " ".join(w)) for i, w in enumerate(sequences(9, 150))]
    rows += [(1000 + i, " ".join(f"w{k}" for k in range(i))) for i in range(40)]
    got = {r.doc_id: tuple(r)[1:] for r in periodic.run_digests(documents(*rows)).collect()}
    assert got == {d: brute_row(d, t) for d, t in rows}
    assert sum(r[0] > 0 for r in got.values()) > 60


def test_odd_rows(odd, documents):
    got = sorted((tuple(r) for r in periodic.run_digests(odd).collect()), key=str)
    assert got == sorted(((d, *brute_row(d, t)) for d, t in ODD_ROWS), key=str)
    assert periodic.run_digests(documents((1, "a")).where("false")).collect() == []


def test_a_very_long_text(documents):
    long = "\n".join(["the same line of nine words comes again here"] * 4000)
    row = periodic.periodic_runs(documents((5, long))).first()
    assert [tuple(r) for r in row.runs] == [(0, 36000, 9)]


def test_collapsed_documents_keep_their_columns(documents):
    from pyspark.sql import functions as F

    docs = documents((1, "a b  a b a b a b a b a b a b c"), (2, "plain  text")).withColumn("runs", F.lit(7))
    got = {r.doc_id: (r.text, r.runs, r.source) for r in periodic.collapse_runs(docs).collect()}
    assert periodic.collapse_runs(docs).columns == docs.columns
    assert got == {1: ("a b c", 7, "a"), 2: ("plain text", 7, "a")}
    assert [r.runs for r in periodic.periodic_runs(docs, ("doc_id", "runs")).where("doc_id = 2").collect()] == [[]]
