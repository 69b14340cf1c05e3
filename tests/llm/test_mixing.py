from collections import Counter, defaultdict

import duckdb

from readtrail.llm import mixing
from tests.llm.conftest import ODD_ROWS


def levels(sizes):
    """Targets by capping and sharing out the excess until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share >= 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * share for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_copies_and_reruns(documents):
    rows = [(i, "w " * (1 + i % 7), [None, "a", "b", "ä", "z", ""][i % 6 if i > 300 else 1]) for i in range(1200)]
    docs = documents(*rows)
    got = {r.doc_id: r for r in mixing.copies(docs).collect()}
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want, taken = levels(sizes), defaultdict(int)
    for doc, text, source in rows:
        r = got[doc]
        assert (r.size, r.source_size) == (len(text.split()), sizes[source])
        assert abs(r.target - want[source]) < 1e-6 * want[source] and r.size * r.n_copies <= 2 * r.size
        taken[source] += r.size * r.n_copies
    assert all(abs(taken[s] - want[s]) < 0.15 * want[s] for s in want)
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    again = {r.doc_id: r.n_copies for r in mixing.copies(docs.repartition(7)).collect()}
    assert again == {d: r.n_copies for d, r in got.items()}


def test_mix_emits_each_copy_with_its_columns(documents):
    docs = documents(*[(i, f"text {i}", "ab"[i % 2]) for i in range(60)]).selectExpr("*", "1 AS size", "2 AS target", "3 AS n_copies")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = Counter(r.doc_id for r in mixed.collect())
    assert counts == Counter({r.doc_id: r.n_copies for r in mixing.copies(docs).collect() if r.n_copies})


def test_odd_rows_and_empty_tables(odd):
    rows = mixing.copies(odd).collect()
    assert len(rows) == len(ODD_ROWS) and all(r.n_copies in (0, 1, 2) for r in rows)
    assert len({r.n_copies for r in rows if r.doc_id == 7}) == 1
    assert mixing.copies(odd.where("false")).collect() == []
    assert all(r.target == 0 and r.n_copies == 0 for r in mixing.copies(odd.where("trim(text) = ''")).collect())


def test_sql_twin(spark, odd, sf_dir):
    from readtrail.llm.queries import op5_mixing

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(mixing.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in op5_mixing(spark, sf_dir).collect()) == want
