import math
import random

import numpy as np

from readtrail.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, step, k=5):
    fit = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows
           if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in fit if i % step == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fit if i != q and len(b) == len(a))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def search(spark, rows, monkeypatch, step=10):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in topk.search(df, df.vec_id % step == 0).collect())


def test_against_brute_force_with_ties_and_odd_vectors(spark, monkeypatch):
    random.seed(4)
    rows = [(i, [random.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(24)], 0) for i in range(150)]
    rows += [(200, None, 0), (210, [], 0), (220, [None] * 24, 0), (230, [float("nan")] * 24, 0),
             (240, [float("inf")] * 24, 0), (None, [1.0] * 24, 0), (250, [1.0, 2.0], 0), (251, [3.0, -1.0], 0), (30, rows[30][1], 0)]
    assert search(spark, rows, monkeypatch) == brute(rows, 10)


def test_large_components_stay_exact(spark, monkeypatch):
    rows = [(i, [float((i * 7919) % 1000003) * 0.5, float(i) * 3e4, 1e5], 0) for i in range(60)]
    assert search(spark, rows, monkeypatch) == brute(rows, 10)


def test_pruning_keeps_the_best():
    random_state = np.random.default_rng(1)
    columns = random_state.integers(-300, 300, (64, 500))
    block = topk.Candidates(np.arange(500), columns)
    for own in range(0, 500, 25):
        ids, scores = block.best(columns[:, own], own, 5)
        want = columns[:, own] @ columns
        order = sorted((i for i in range(500) if i != own), key=lambda i: (-want[i], i))[:5]
        assert ids.tolist() == order and scores.tolist() == [want[i] for i in order]


def test_empty_table(spark):
    assert topk.search(spark.createDataFrame([], SCHEMA)).collect() == []
