import os
from collections import Counter, defaultdict

import duckdb

from readtrail.llm import shards
from tests.llm.conftest import ODD_ROWS


def check(rows, limit):
    sizes, keys = Counter(), defaultdict(set)
    for r in rows:
        sizes[r.shard] += r.n_bytes
        keys[r.shard].add(r.doc_id)
    for r in rows:
        assert r.shard_bytes == sizes[r.shard]
        assert sizes[r.shard] <= limit or len(keys[r.shard]) == 1
    prefixes = {s.split("-")[0] for s in sizes}
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)  # no shard within another


def test_splits_only_what_is_too_large(documents):
    docs = documents(*[(i, "x" * (i % 97)) for i in range(2000)])
    for limit in (300, 5_000, 10**9):
        rows = shards.assign_shards(docs, limit).collect()
        assert len(rows) == 2000
        check(rows, limit)
        if limit == 300:  # a parent of a shard would not have fitted
            total = Counter()
            bits = {r.doc_id: format(h, "060b") for r, h in ((r, r._hash) for r in docs.withColumn("_hash", shards.prefix_hash("doc_id")).collect())}
            for r in rows:
                for d in range(r.depth):
                    total[bits[r.doc_id][:d]] += r.n_bytes
            assert all(total[r.shard[:-1]] > limit for r in rows if r.depth)


def test_documents_over_the_limit_and_rows_that_share_an_id(documents):
    rows = [(1, "y" * 900), (2, "y" * 1000)] + [(3, "z" * 40)] * 50 + [(None, "n" * 30)] * 40
    out = shards.assign_shards(documents(*rows), 200).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.n_bytes
    assert all(sizes[r.shard] == r.shard_bytes for r in out)
    assert all(r.shard_bytes <= 200 for r in out if r.doc_id in (3, None))


def test_odd_rows_empty_table_and_clashing_columns(odd):
    out = shards.assign_shards(odd.selectExpr("*", "1 AS shard", "2 AS n_bytes"))
    assert out.columns.count("shard") == 1 and out.count() == len(ODD_ROWS)
    assert shards.assign_shards(odd.where("false")).collect() == []


def test_files_hold_one_shard_each(spark, documents, tmp_path):
    docs = documents(*[(i, "x" * 50) for i in range(100)])
    shards.write_shards(shards.assign_shards(docs, 1000), str(tmp_path / "out"))
    folders = [f for f in os.listdir(tmp_path / "out") if f.startswith("shard=")]
    assert len(folders) >= 5
    assert all(sum(f.endswith(".parquet") for f in os.listdir(tmp_path / "out" / d)) == 1 for d in folders)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_texts_are_not_shuffled_to_find_their_shards(documents):
    docs = documents(*[(i, "x" * 50) for i in range(100)]).localCheckpoint()
    for limit in (1000, 10**9):
        plan = shards.assign_shards(docs, limit).select("doc_id", "text", "shard")._jdf.queryExecution().optimizedPlan().toString()
        assert "rightHint=(strategy=broadcast)" in plan


def test_rows_read_back_from_files(spark, documents, odd, tmp_path):
    cases = {"many": (documents(*[(i, "x" * 50) for i in range(100)]), 1000), "odd": (odd, 100), "one": (odd, 10**9),
             "none": (odd.where("false"), 100)}
    for name, (docs, limit) in cases.items():
        want = shards.assign_shards(docs.select("doc_id", "text"), limit)
        shards.write_shards(want.select("doc_id", "text", "shard"), str(tmp_path / name))
        got = shards.read_shards(spark, str(tmp_path / name))
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        check(got.collect(), max(limit, 15000))


def test_sql_twin(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for limit in (60_000, shards.LIMIT_BYTES):
        got = shards.assign_shards(docs, limit).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes")
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(shards.oracle_sql(limit)).fetchall())
