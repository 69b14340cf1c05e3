import numpy as np

from readtrail.llm import quality
from tests.llm.conftest import ODD_ROWS


def test_shapes_and_repeats():
    assert [quality.shape(w) for w in ("the", "The", "THE!!", "de%%%", "12-ab", "|", "A")] == ["a", "Aa", "A!", "a%", "0-a", "|", "Aa"]
    again = len(np.setdiff1d(quality.features("so so so"), quality.features("so to no")))
    assert again > 0 and not len(quality.features("")) and not len(quality.features(" \n"))


def test_ratios_by_hand():
    rows = [np.array([1, 2]), np.array([2])]
    r = quality.log_count_ratios(rows, np.array([1, -1]))
    n = 1 << quality.SPACE_BITS
    assert np.isclose(r[1], np.log((2 / (n + 2)) / (1 / (n + 1)))) and np.isclose(r[2], np.log((n + 1) / (n + 2)))


def test_dual_descent_reaches_the_hinge_optimum():
    random = np.random.default_rng(2)
    x = np.hstack([random.normal(size=(60, 2)), np.ones((60, 1))])
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 * random.normal(size=60) > 0, 1, -1)
    w, bias = quality.dual_descent([(np.array([0, 1]), r[:2]) for r in x], y, 2, epochs=500)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    found = np.append(w, bias)
    assert all(loss(found) <= loss(found + d) + 1e-3 for d in random.normal(scale=0.05, size=(200, 3)))


def test_learns_and_scores_held_out_rows(spark, sf_dir):
    from readtrail.llm.queries import op6_quality

    folder = sf_dir.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in op6_quality(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [(rows[d].predicted, q) for d, q in labels.items() if rows[d].held_out]
    assert np.mean([p == q for p, q in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())


def test_odd_rows_missing_classes_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, None), (None, 1), (5, 1)], "doc_id long, quality int")
    for some in (labels, labels.where("quality = 1"), labels.where("false")):
        model = quality.train(odd, some)
        out = quality.score_documents(odd, model).collect()
        assert len(out) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in out)
    assert quality.score_documents(odd.where("false"), model).collect() == []
    clash = odd.selectExpr("*", "1 AS score", "2 AS predicted")
    assert quality.good_documents(clash, model).columns == clash.columns
    by_text = {}
    assert all(by_text.setdefault(str(r.doc_id == 7), r.score) == r.score for r in out if r.doc_id == 7)
