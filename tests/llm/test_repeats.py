import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import pytest

from readtrail.llm import anchors, repeats
from readtrail.llm.suffix_sort import blind_trie_order, deep_shallow_sort


def brute(rows):
    seen, out = set(), {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            window = data[s:s + 100]
            if window in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(window)
        rest = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def texts(seed, n=25):
    r = random.Random(seed)
    pool = ["".join(r.choice(r.choice(["ab", "abcdefgh ", "é\0a"])) for _ in range(r.randint(30, 260))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [r.choice([r.choice(pool), r.choice(pool)[r.randint(0, 50):r.randint(60, 200)],
                           "".join(r.choice("abcxyz") for _ in range(r.randint(0, 90)))]) for _ in range(r.randint(0, 6))]
        out.append("".join(parts))
    return out + ["ab" * 200, "z" * 350, "z" * 99, "", None, out[0]]


@pytest.mark.parametrize("seed,segment,hot", [(1, None, None), (2, 450, None), (3, None, 2), (4, 450, 0)])
def test_against_brute_force(documents, monkeypatch, seed, segment, hot):
    """Whole texts, texts cut in overlapping segments, and all grams taken as very common ones."""
    rows = list(enumerate(texts(seed)))
    if segment or hot is not None:  # patched values reach workers only through the functions' arguments
        got = in_process(rows, segment, hot, monkeypatch)
    else:
        got = {r.doc_id: tuple(r)[1:] for r in repeats.removal_digests(documents(*rows)).collect()}
    assert got == brute(rows)


def in_process(rows, segment, hot, monkeypatch, buckets=3):
    """The steps of the job on plain tables."""
    import pyarrow as pa

    if segment:
        monkeypatch.setattr(anchors, "SEGMENT", segment)
    data = {d: (t or "").encode() for d, t in rows}
    marks = []
    for part in range(3):
        mine = rows[part::3]
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in mine]), pa.array([t or "" for _, t in mine])], names=["r", "t"])
        marks += repeats._scan(buckets)([batch])
    names = ["bucket", "kind", "row", "low", "high", "place", "gram", "data"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    reduced = [dict(zip(names[1:], m[1:])) for m in marks if m[1] != repeats.ASK]
    for b in range(buckets):
        own = [m for m in marks if m[0] == b and m[1] == repeats.ASK]
        if own:
            reduced += repeats._reduce(pa.table([pa.array(list(c), k) for c, k in zip(zip(*own), kinds)], names=names)).to_pylist()
    cuts = [(m["row"], m["low"], m["high"]) for m in reduced if m["kind"] == repeats.CUT]
    contexts = [
        (m["row"], m["low"], m["place"], m["data"] if m["kind"] == repeats.CONTEXT else data[m["row"]][m["low"]:m["high"]], m["gram"])
        for m in reduced if m["kind"] != repeats.CUT
    ]
    common = {g for *_, g in contexts if hot is not None and sum(c[4] == g for c in contexts) > hot}
    cold = [c for c in contexts if c[4] not in common]
    if cold:
        table = pa.table([pa.array(list(c), k) for c, k in zip(list(zip(*cold))[:4], [pa.int64(), pa.int32(), pa.int32(), pa.binary()])],
                         names=["row", "low", "place", "data"])
        cuts += [(m["row"], m["low"], m["high"]) for m in repeats._compare(table).to_pylist()]
    first = {}
    windows = [(c[3][k:k + 100], c[0], c[1] + k) for c in contexts if c[4] in common for k in range(len(c[3]) - 99)]
    for window, row, low in windows:
        first[window] = min(first.get(window, (row, low)), (row, low))
    cuts += [(row, low, low + 100) for window, row, low in windows if (row, low) > first[window]]
    out = {}
    for doc, text in rows:
        spans, rest = repeats._cut(text or "", [{"low": a, "high": b} for r, a, b in cuts if r == doc])
        out[doc] = (len(data[doc]), len(data[doc]) - len(rest), len(spans), hashlib.sha256(rest).hexdigest())
    return out


def test_common_grams_through_spark(documents, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", 3)
    line = "This line is found in very many documents of the corpus, with other words around it each time, over 100."
    rows = [(i, f"{i * 7919} {line} {i * 104729}") for i in range(40)]
    got = {r.doc_id: tuple(r)[1:] for r in repeats.removal_digests(documents(*rows)).collect()}
    assert got == brute(rows)


def test_deep_shallow_sort():
    random_state = np.random.default_rng(0)
    rows = random_state.integers(0, 2, (400, 40)).astype(np.uint8)
    rows[100:200] = rows[:100]
    rows[200:300, :30] = rows[0, :30]
    sizes = random_state.integers(0, 41, 400)
    for i, n in enumerate(sizes):
        rows[i, n:] = 0
    for shallow in (1, 3, 5):
        order, common = deep_shallow_sort(rows, sizes, shallow)
        keys = [(rows[i].tobytes(), int(sizes[i])) for i in order]
        assert keys == sorted(keys)
        for k in range(1, 400):
            a, b = rows[order[k]], rows[order[k - 1]]
            same = next((i for i in range(40) if a[i] != b[i]), 40)
            assert common[k] == min(same, sizes[order[k]], sizes[order[k - 1]])
    values = [5, 3, 5, 0, 9, 3]
    assert [values[i] for i in blind_trie_order(values)] == sorted(values)


def test_odd_rows(odd):
    rows = repeats.remove_repeats(odd.selectExpr("*", "1 AS row", "2 AS kept"), keep=("doc_id", "row")).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].kept == b"" and by_id[4].kept == b"one" and by_id[5].spans[0].low in range(1, 10)
    assert bytes(by_id[8].kept).decode() == "é\0▁ 中 😀\r\nline"
    assert repeats.removal_digests(odd.where("false")).collect() == []


def test_rows_that_share_an_id_follow_each_other(documents):
    text = "".join(random.Random(5).choices("abcdefgh", k=300))
    out = repeats.removal_digests(documents((1, text), (1, text), (None, text), (2, "short"))).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in out) == [(5, 0), (300, 0), (300, 300), (300, 300)]


def test_texts_left_keep_their_columns(documents):
    text = "é" * 10 + "".join(random.Random(6).choices("abcdefgh", k=300))
    docs = documents((1, text), (2, text), (3, "x" + text[5:] + "tail"), (4, None)).selectExpr("*", "1 AS _span")
    out = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert set(out) == {1, 3, 4} and out[3].text == "xtail" and out[3].n_chars == 5 and out[1].text == text


def test_fresh_workers(tmp_path):
    """Every task in a worker of its own: nothing relies on what an earlier task imported."""
    script = tmp_path / "fresh.py"
    script.write_text(
        "from pyspark.sql import SparkSession\n"
        "from readtrail.llm import repeats\n"
        "spark = (SparkSession.builder.master('local[2]').config('spark.python.worker.reuse', 'false')\n"
        "         .config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate())\n"
        "line = ' '.join(f'common word {i}' for i in range(30))\n"
        "docs = spark.createDataFrame([(i, f'{i} {line} {i * 7}') for i in range(6)], 'doc_id long, text string')\n"
        "print('removed', sum(r.n_removed > 0 for r in repeats.removal_digests(docs).collect()))\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=300,
                          env={**os.environ, "PYTHONPATH": root})
    assert "removed 5" in done.stdout, done.stderr[-2000:]
