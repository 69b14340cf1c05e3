import hashlib
import random

import numpy as np

from readtrail.llm import fingerprints as fp
from tests.llm.conftest import ODD_ROWS


def likeness(a, b, k=5):
    cut = lambda t: {tuple(t.split()[i:i + k]) for i in range(max(1, len(t.split()) - k + 1))} if t.split() else set()
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_estimates_and_edits(documents):
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(40, 400)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    got = {x.doc_id: x for x in fp.compare_with_edits(documents(*rows, partitions=5)).collect()}
    ids = sorted(dict(rows), reverse=True)
    text = dict(rows)
    errors = []
    for i, doc in enumerate(ids):
        own, following = text[doc], text[ids[(i + 1) % len(ids)]]
        half = len(own) // 2
        changed = own[:len(own) - half] + following[:half]
        x = got[doc]
        assert (x.n_chars, x.edited_sha256) == (len(own), hashlib.sha256(changed.encode()).hexdigest())
        errors.append(x.near_edited - likeness(own, changed))
        assert abs(x.near_next - likeness(own, following)) < 0.1
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    assert all(got[100 + i].fingerprint == got[i].fingerprint for i in range(5))


def test_empty_bins_borrow_alike_and_bits_pack():
    maker = fp.Fingerprinter()
    for text in ("one", "one two three four five six", "x " * 2000):
        bins = maker.bins(text)
        assert len(bins) == fp.BINS and (fp.unpacked(fp.packed(bins)) == bins).all()
        assert fp.likeness(bins, fp.Fingerprinter().bins(text)) == 1.0
    assert fp.likeness(maker.bins("one"), maker.bins("two")) < 0.1
    assert (fp.likeness(None, None), fp.likeness(None, maker.bins("a"))) == (1.0, 0.0)


def test_odd_rows(documents, odd):
    out = fp.compare_with_edits(odd.selectExpr("*", "1 AS fingerprint", "2 AS _part")).collect()
    assert len(out) == len(ODD_ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert all(r.fingerprint == "" for r in out if r.doc_id in (1, 2, 3))
    assert fp.compare_with_edits(odd.where("false")).collect() == []
    (single,) = fp.compare_with_edits(documents((9, "abcd"))).collect()
    assert single.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fp.fingerprint_documents(odd).count() == len(ODD_ROWS)
